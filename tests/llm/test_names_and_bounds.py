"""Columns of the caller that are named like those used inside, text ids, and the bound on the fitted sample."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapeaudit.llm import decontaminate, language_id, line_dedup, minhash
from tapeaudit.llm.common import unused

PASSAGE = "alpha one\nbeta two\ngamma three"
INSIDE = ["drop", "__drop", "row_id", "row_fp", "__row_id", "__row_fp", "_row_fp", "one", "__one", "doc", "at", "first", "class", "number", "__text", "held_out", "words", "n_hit"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, PASSAGE + "\nown line"), (2, "other\n" + PASSAGE), (3, PASSAGE + "\nown line"), (None, None)]
    base = spark.createDataFrame(rows, "doc_id bigint, text string")
    return base.withColumns({c: F.concat(F.lit(c + "-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in INSIDE})


def kept_as_they_were(out, skip=()):
    for row in out.collect():
        key = "none" if row.doc_id is None else str(row.doc_id)
        for c in INSIDE:
            assert c in skip or row[c] == f"{c}-{key}", c


def test_unused(docs):
    assert unused(docs, "__row_id", "fresh", "DROP") == ["___row_id", "fresh", "_DROP"]


def test_line_dedup_leaves_columns_of_any_name(docs):
    out = line_dedup.line_dedup(docs)
    kept_as_they_were(out)
    assert {r.doc_id: r.n_removed for r in out.collect()} == {1: 0, 2: 3, 3: 4, None: 0}
    assert set(out.columns) == {*docs.columns, "n_lines", "n_removed"}


def test_keep_one_leaves_columns_of_any_name(docs):
    out = minhash.keep_one(docs)
    kept_as_they_were(out)
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 2, None]) and out.columns == docs.columns


def test_predict_and_decontaminate_take_columns_of_any_name(spark, docs):
    kept_as_they_were(language_id.predict(docs, None))
    items = spark.createDataFrame([(1, "alpha one beta two gamma three", 1)], "item_id int, text string, start int")
    assert {r.doc_id: r.contaminated for r in decontaminate.decontaminate(docs, items).collect()} == {1: True, 2: True, 3: True, None: False}


def test_text_ids(spark):
    rows = [("b", PASSAGE), ("<q>", PASSAGE), ("", "first\n" + PASSAGE), (None, PASSAGE + "\nlast"), ("é", PASSAGE)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id string, text string"))
    assert {r.doc_id: r.n_removed for r in out.collect()} == {"": 0, "<q>": 3, "b": 3, "é": 3, None: 3}


def test_repeated_rows_do_not_add_to_the_sample(spark, monkeypatch):
    """Of rows that share an id and a text one is fitted: the model is that of the rows without their repeats."""
    rows = [(i, f"{a} {i} {b}", lang) for lang, a, b in (("en", "the cat sat on", "old mats"), ("de", "der Hund lag auf", "alten Decken")) for i in range(40)]
    rows = [(i + 100 * (lang == "de"), t, lang) for i, t, lang in rows]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    lots = plain.unionByName(plain.filter("doc_id = 1 or doc_id = 101").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("k"))
    # document frequencies and the shares of the languages count every row, so they are held equal here
    monkeypatch.setattr(language_id, "_document_counts", lambda texts: (language_id.np.ones(language_id.SLOTS, language_id.np.int64), 100))
    a, b = language_id.fit(plain, sample=1000), language_id.fit(lots, sample=1000)
    assert a.languages == b.languages and (a.weights != 0).sum() >= (b.weights != 0).sum() > 0
    got = {r.lang_pred for r in language_id.predict(spark.createDataFrame([(1, "der Hund lag auf alten Decken")], "doc_id bigint, text string"), b).collect()}
    assert got == {"de"}


def test_pair_table_and_few_lookups(monkeypatch):
    """The table knows exactly the merges, and merging many words looks up each pair once and new symbols' pairs only."""
    import random

    import numpy as np

    from tapeaudit.llm import bpe
    from tapeaudit.llm.queries import vocabulary_path

    v = bpe.load(vocabulary_path("byte_bpe_50k.json"))
    rng = random.Random(3)
    n = len(v.texts)
    pairs = [*v.by_pair, *[(rng.randrange(n), rng.randrange(n)) for _ in range(50_000)]]
    a, b = np.array(pairs, np.int64).T
    assert bpe.pair_ranks(v, a, b).tolist() == [v.by_pair.get(p, int(bpe._NEVER)) for p in pairs]

    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 60))).encode() for _ in range(300)] + [b"", b"a" * 40]
    parts = [bpe.split(v, w) for w in words]
    asked, look = [], bpe.pair_ranks
    monkeypatch.setattr(bpe, "pair_ranks", lambda v, x, y: asked.append(len(x)) or look(v, x, y))
    got = bpe.merge_many(v, parts)
    assert got == [bpe.merge(v, p) for p in parts]
    letters, merges = sum(map(len, parts)), sum(map(len, parts)) - sum(map(len, got))
    assert sum(asked) <= letters + 2 * merges
