"""Benchmark decontamination with a positional inverted index over the documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cut
from .common import ascii_lower, hinted, let, words

WINDOW = 13
#: Bits of the filter that tells which words may be indexed terms; a fixed 32 KB whatever the benchmark's size.
FILTER_BITS = 1 << 18
#: Rarest terms of a window whose lists are intersected.
ANCHORS = 2


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    i, text = F.col(id_col), F.col(text_col)
    return docs.select(
        i.alias("id"), F.coalesce(i.cast("string"), F.lit("")).alias("row_id"),
        F.xxhash64(i.isNull(), text).alias("row_fp"), words(text).alias("words"),
    )


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Each window of each item once: item_id, window (array of words), wid (128-bit name of the window's words)."""
    ws = F.split(ascii_lower(F.array_join(words(F.col(text_col)), " ")), " ")

    def runs(w: Column) -> Column:
        n = F.size(w)
        return F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.slice(w, i + 1, size))

    return (
        items.select(F.col(id_col).alias("item_id"), F.explode(let(ws, runs)).alias("window"))
        .filter(F.element_at("window", 1) != "").distinct()
        .withColumn("wid", F.unhex(F.md5(F.array_join("window", " "))))
    )


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each of `terms` occurs in all documents: term, n (0 where it never does)."""
    said = docs.select(F.explode(words(F.col(text_col))).alias("word")).select(ascii_lower(F.col("word")).alias("term"))
    seen = said.join(hinted(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def rarest_terms(windows: DataFrame, counts: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """The rarest terms of each window: wid, term, offset (its place in the window), role (0 is the rarest)."""
    placed = windows.select("wid", "window").dropDuplicates(["wid"]).select("wid", F.posexplode("window").alias("offset", "term"))
    order = Window.partitionBy("wid").orderBy("n", "term", "offset")  # a window has `size` rows at most
    return (
        placed.join(hinted(counts), "term").withColumn("role", F.row_number().over(order) - 1)
        .filter(F.col("role") < anchors).select("wid", "term", "offset", "role")
    )


def _bits(terms: DataFrame, bits: int) -> np.ndarray:
    """A filter of fixed size with the bit of each term's hash set, as 64-bit words."""
    slot = F.pmod(F.xxhash64("term"), F.lit(bits))
    rows = (
        terms.select((slot / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(term), {bits}) % 64 as int))").alias("bit"))
        .groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
    )
    out = np.zeros(bits // 64, np.int64)
    for r in rows:
        out[r["at"]] = r["bits"]
    return out


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = WINDOW - 1) -> DataFrame:
    """The positional index of `terms` over all documents: term, row_id, row_fp, at, left, around.

    `at` is the word's place; `around` holds the words from `left` places before it to `reach` after it, so
    that a phrase which the lists propose is compared word by word without going back to the texts.
    """
    bits = ",".join(map(str, _bits(terms, FILTER_BITS).tolist()))
    maybe = F.split(F.lit(bits), ",").cast("array<bigint>")  # folded into one literal when the query is planned

    def known(term: Column) -> Column:
        slot = F.pmod(F.xxhash64(term), F.lit(FILTER_BITS))
        return F.getbit(F.get(maybe, F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int")) == 1

    def listed(ws: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: known(ascii_lower(F.get(ws, i))))
        return F.transform(places, lambda i: F.struct(
            i.alias("at"), ascii_lower(F.get(ws, i)).alias("term"), F.least(i, F.lit(reach)).alias("left"),
            F.transform(F.slice(ws, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + 1 + reach), ascii_lower).alias("around"),
        ))

    entries = F.when(F.size("words") > 0, let(F.col("words"), listed))
    return (
        _keyed(docs, id_col, text_col).select("row_id", "row_fp", F.explode(entries).alias("p"))
        .select("p.term", "row_id", "row_fp", "p.at", "p.left", "p.around").join(hinted(terms), "term", "left_semi")
    )


def phrase_matches(index: DataFrame, anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """Exact occurrences of windows: wid, row_id, row_fp, start, length.

    A posting of a window's term proposes the start at - offset. The lists of its rarest terms are
    intersected on (window, document, start); what is left is compared word by word.
    """
    texts = hinted(windows.select("wid", "window").dropDuplicates(["wid"]))
    place = ["wid", "row_id", "row_fp", "start"]
    proposed = (
        index.join(hinted(anchors), "term")
        .select("wid", "row_id", "row_fp", (F.col("at") - F.col("offset")).alias("start"), "role", "offset", "left", "around")
        .filter("start >= 0 and left >= offset")
    )
    found = proposed.filter("role = 0")
    for role in range(1, ANCHORS):
        with_role = anchors.filter(F.col("role") == role).select("wid").distinct()
        others = proposed.filter(F.col("role") == role).select(*place)
        # a window of one word has one list: it has nothing to intersect with
        found = found.join(hinted(with_role.withColumn("more", F.lit(True))), "wid", "left")
        alone = found.filter("more is null").drop("more")
        found = found.filter("more").drop("more").join(others, place, "left_semi").unionByName(alone)
    same = F.slice("around", F.col("left") - F.col("offset") + 1, F.size("window")) == F.col("window")
    return found.join(texts, "wid").filter(same).select(*place, F.size("window").alias("length"))


def proximity_matches(index: DataFrame, anchors: DataFrame, slop: int) -> DataFrame:
    """Places where the two rarest terms of a window lie within `slop` words of their distance in the window:
    wid, row_id, row_fp, start (that the rarest term proposes), shift (0 for the exact distance).

    Both lists are cut into spans of slop + 1 starts and meet in equal or neighbouring spans, so the
    work follows the lists' lengths.
    """
    span = slop + 1
    at = index.join(hinted(anchors), "term").select("wid", "row_id", "row_fp", (F.col("at") - F.col("offset")).alias("start"), "role")
    one = at.filter("role = 0").withColumn("span", F.explode(F.array(*[F.floor(F.col("start") / span) + k for k in (-1, 0, 1)])))
    two = at.filter("role = 1").select("wid", "row_id", "row_fp", F.col("start").alias("other"), F.floor(F.col("start") / span).alias("span"))
    shift = F.col("other") - F.col("start")
    return (
        one.join(two, ["wid", "row_id", "row_fp", "span"]).filter(F.abs(shift) <= slop)
        .groupBy("wid", "row_id", "row_fp", "start").agg(F.min(F.abs(shift)).alias("shift"))
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", size: int = WINDOW, share: int = 20,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, and row_id and row_fp, which tell rows apart.

    Words are runs of a-z (after lower-casing A-Z), digits and characters beyond ASCII. A window is `size`
    consecutive words of an item; a shorter item is one window. Words inside any occurrence of a window are
    hit. A document is contaminated when `share` times its hit words reach all its words.

    Only the benchmark's rarest terms are indexed; the texts are read three times (term counts, postings,
    words per document) and never shuffled. Hits are merged per document; a passage that a third of the
    documents hold is a few rows in each of them.

    A null, empty or wordless text has no words and is clean; a wordless item has no windows. Items that
    repeat an id add their windows to it; a null item_id counts as an item, named by the empty string. Rows
    that repeat an id and a text are alike; rows that share only the id are kept apart. Empty tables
    give no rows, or clean ones.
    """
    windows = item_windows(items, item_col, item_text, size)
    counts = term_counts(docs, windows.select(F.explode("window").alias("term")).distinct(), text_col).transform(cut)
    anchors = rarest_terms(windows, counts).transform(cut)
    index = postings(docs, anchors.select("term").distinct(), id_col, text_col, size - 1).transform(cut)
    matches = phrase_matches(index, anchors, windows).transform(cut)

    row = ["row_id", "row_fp"]
    spans = matches.groupBy(*row, "start").agg(F.max("length").alias("length"))
    order = Window.partitionBy(*row).orderBy("start")  # bounded by the words of one text
    reach = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("start") + F.col("length") - F.greatest("start", F.coalesce("reach", F.lit(0)))
    hits = spans.withColumn("reach", reach).groupBy(*row).agg(F.sum(F.greatest(fresh, F.lit(0))).alias("n_hit"))
    names = windows.select("wid", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()
    per_item = matches.select("wid", *row).distinct().join(hinted(names), "wid").groupBy(*row).agg(F.sort_array(F.collect_set("item")).alias("items"))

    n_hit, n_words = F.coalesce("n_hit", F.lit(0)).cast("bigint"), F.col("n_words")
    return (
        _keyed(docs, id_col, text_col).select("id", *row, F.size("words").cast("bigint").alias("n_words"))
        .join(hits, row, "left").join(per_item, row, "left")
        .select(
            F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"),
            F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("bigint").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            ((n_hit > 0) & (n_hit * share >= n_words)).alias("contaminated"), *row,
        )
    )

