"""Chains that go on from stored heads."""

import hashlib
import json

from pyspark.sql import functions as F

from tapeaudit.operators import trials
from tapeaudit.operators.ledger import GENESIS, Ledger, canonical


def test_batches_verify_as_one_chain_and_a_repeat_changes_nothing(spark, tmp_path):
    stored = Ledger(spark, str(tmp_path / "l"), {"book": "string"})
    rows = [("a", i, None if i == 3 else json.dumps({"n": i})) for i in range(40)] + [("b", i, f"x{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "book string, k int, payload string").repartition(5)
    for name, part in {"one": "k < 2", "two": "k between 2 and 20", "three": "k > 20"}.items():
        for _ in range(2):
            stored.append(df.filter(part), "k", name)
    want = []
    for book in "ab":
        before = GENESIS
        for b, k, text in sorted((r for r in rows if r[0] == book), key=lambda r: r[1]):
            mine = hashlib.sha256((before + ("null" if text is None else text)).encode()).hexdigest()
            want.append((b, k, text, before, mine))
            before = mine
    assert sorted(map(tuple, stored.entries().collect()), key=lambda r: r[:2]) == want
    assert {(r.book, r.seq) for r in stored.heads().collect()} == {("a", 39), ("b", 2)}
    assert all(r.ok == 1 for r in trials.chain_verify(stored.entries(), ["book"]).collect())
    # an attempt that was never published
    df.limit(1).select("book", F.lit(99).cast("bigint").alias("seq"), "payload", F.lit("").alias("prev_hash"), F.lit("").alias("entry_hash")).write.parquet(f"{tmp_path}/l/entries/version=3")
    assert stored.entries().count() == 43
    stored.append(df.limit(0), "k", "four")
    assert stored.entries().count() == 43


def test_every_kind_of_damage_is_found(spark, tmp_path):
    stored = Ledger(spark, str(tmp_path / "l"), {"book": "string"})
    stored.append(spark.createDataFrame([("a", i, f"x{i}") for i in range(6)], "book string, k int, payload string"), "k", "one")
    e = stored.entries()
    edited = e.withColumn("payload", F.when(F.col("seq") == 3, "y").otherwise(F.col("payload")))
    removed = e.filter("seq <> 2")
    forged = edited.withColumn("entry_hash", F.when(F.col("seq") == 3, F.sha2(F.concat("prev_hash", F.lit("y")), 256)).otherwise(F.col("entry_hash")))
    for bad, first, why in ((edited, 3, trials.BODY), (removed, 3, trials.LINK), (forged, 4, trials.LINK)):
        (r,) = trials.chain_verify(bad, ["book"]).collect()
        assert (r.ok, r.first_bad, r.reason) == (0, first, why)


def test_canonical_text_keeps_nulls_and_sorts_keys(spark):
    r = spark.createDataFrame([(2, None, "é")], "b int, a string, c string").select(canonical("c", "a", "b").alias("j")).first()
    assert r.j == '{"a":null,"b":2,"c":"é"}'
