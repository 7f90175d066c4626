"""Line dedup on overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, unused

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(lines: Column, size: int) -> Column:
    """For each run of `size` lines its position and a 128-bit hash; runs of blank lines alone have none."""

    def run(i: Column) -> Column:
        part = [F.get(lines, i + k) for k in range(size)]
        blank = part[0].rlike(r"^\s*$")
        for p in part[1:]:
            blank = blank & p.rlike(r"^\s*$")
        return F.struct(
            i.alias("at"), F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit(7), *reversed(part)).alias("h2"),
            blank.alias("blank"),
        )

    n = F.size(lines)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), run)
    return F.when(n >= size, F.filter(runs, lambda w: ~w.blank))


def _order(docs: DataFrame, id_col: str) -> Column:
    """A value by which ids, integers or texts, sort; rows without one come last."""
    i = F.col(id_col)
    if docs.select(i).schema[0].dataType.typeName() in ("string", "varchar", "char"):
        return F.when(i.isNull(), "1").otherwise(F.concat(F.lit("0"), i))
    return F.coalesce(i.cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """The line numbers that later occurrences of a window cover: __row_id, __row_fp, drop (array).

    A window is `size` consecutive lines. All occurrences of one window meet in an aggregate that tasks
    prepare on their own (a window that is everywhere costs a row per task), which leaves the place of the
    first one. The other occurrences come from the join with the repeated windows; the adaptive
    planner splits a hot one. Their lines are merged per document, which is bounded by its own text.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__row_id"),
        F.xxhash64(F.col(id_col).isNull(), F.col(text_col)).alias("__row_fp"),
        _order(docs, id_col).alias("doc"),
        F.explode(let(_lines(F.col(text_col)), lambda lines: _windows(lines, size))).alias("w"),
    )
    places = rows.select("__row_id", "__row_fp", "doc", "w.at", "w.h1", "w.h2")
    # rows that share an id, or have none, are told apart by their texts, so that no two rows have equal places
    place = F.struct("doc", "__row_fp", "at")
    first = (
        places.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("h1", "h2", "first")
    )
    later = places.join(first, ["h1", "h2"]).filter(place > F.col("first"))
    cover = F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + size - 1)))
    return later.groupBy("__row_id", "__row_fp").agg(F.array_distinct(cover).alias("drop"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """`docs` with the repeated lines taken out of the text, plus n_lines and n_removed.

    A line goes when it lies in an occurrence of a window of `size` lines that occurred before: in a document
    with a smaller id, or higher up in the same one. First occurrences stay whole, so the lines of a removed
    passage are still in the corpus.

    A null text stays null (0 lines); an empty one has one empty line. Texts of fewer than `size` lines have
    no window and stay as they are, and so do runs of blank lines. A text may end up empty. Rows that repeat
    an id and a text are one document and are treated alike. Rows without an id count as the last ones. Different
    texts that share an id, or have none, come in the order of their hashes. Ids are integers or texts, which sort as
    texts. Columns of `docs` that are called n_lines or n_removed are replaced; others stay, whatever their names.
    """
    row_id, row_fp, gone = unused(docs, "__row_id", "__row_fp", "__drop")
    drop = repeated_lines(docs, id_col, text_col, size).toDF(row_id, row_fp, gone)
    text = F.col(text_col)
    keyed = docs.drop("n_lines", "n_removed").withColumns({
        row_id: F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        row_fp: F.xxhash64(F.col(id_col).isNull(), text),
    })

    def left(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return keyed.join(drop, [row_id, row_fp], "left").withColumns({
        text_col: F.when(F.col(gone).isNull(), text).otherwise(let(_lines(text), left)),
        "n_lines": F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("bigint"),
        "n_removed": F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("bigint"),
    }).drop(row_id, row_fp, gone)
