"""Streams over several micro-batches: repeats, late files, restarts, outcomes that never come."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeaudit.operators import quality
from tapeaudit.streaming import flows

TICK = "event_id bigint, ts timestamp_ntz, value double"
BAR = "symbol string, dt date, open double, high double, low double, close double, adj_close double, volume bigint"


def at(minute, day=2):
    return dt.datetime(2024, 1, day, 10, minute)


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def run_bars(spark, root, name, per_trigger=1):
    s = flows.read_files(spark, f"{root}/in", TICK, per_trigger=per_trigger).withColumn("symbol", F.lit("X"))
    flows.stream_upsert_bars(s, f"{root}/table", f"{root}/check-{name}")
    return {r.hour: r for r in flows.latest_bars(spark, f"{root}/table").collect()}


def test_hours_come_together_and_events_count_once(spark, tmp_path):
    put(spark, [(1, at(5), 7.0), (2, at(9), 8.0), (None, at(11), 9.0), (None, at(12), 9.0)], TICK, tmp_path / "in/a")
    put(spark, [(3, at(1), 5.0), (4, at(50), 50.0), (1, at(5), 7.0), (None, at(11), 9.0)], TICK, tmp_path / "in/b")
    for name in ("one", "two"):  # the second stream delivers all of it again
        b = run_bars(spark, tmp_path, name)[dt.datetime(2024, 1, 2, 10)]
        assert (b.open, b.high, b.low, b.close, b.volume) == (5.0, 50.0, 5.0, 50.0, 6)


def test_files_of_one_name_in_two_folders_both_count(spark, tmp_path):
    for k, folder in enumerate(("2024-01-02", "2024-01-03")):
        put(spark, [(2 * k, at(k), 1.0 + k), (2 * k + 1, at(30 + k), 3.0 + k)], TICK, tmp_path / "made" / folder)
        (part,) = (tmp_path / "made" / folder).glob("*.parquet")
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "ticks.parquet").write_bytes(part.read_bytes())
    (bar,) = run_bars(spark, tmp_path, "x").values()
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume) == (1.0, 4.0, 1.0, 4.0, 4)


def test_a_batch_touches_its_days_and_a_retry_changes_nothing(spark, tmp_path):
    table = flows.bar_table(spark, str(tmp_path / "t"))
    cast = [(i, "X", at(i % 50, day), float(i)) for i, day in enumerate([2] * 30 + [3] * 30)]
    batch = spark.createDataFrame(cast, "event_id bigint, symbol string, ts timestamp_ntz, value double")
    table.merge(batch, "s", 0)
    more = spark.createDataFrame([(900, "X", at(59, 3), 1.0), (1, "X", at(1), 1.0)], batch.schema)
    # an attempt that died before it was published
    more.withColumn("part", F.lit("2024-01-03")).write.partitionBy("part").parquet(f"{tmp_path}/t/rows/version=1")
    assert table.read().count() == 60
    table.merge(more, "s", 1)
    table.merge(more, "s", 1)
    table.merge(batch, "other", 0)
    assert {(r.part, r.version) for r in table.manifest().collect()} == {("2024-01-02", 0), ("2024-01-03", 0), ("2024-01-03", 1)}
    assert table.read().count() == 61 and table.read("bars").agg(F.sum("volume")).first()[0] == 61
    assert flows.bar_table(spark, str(tmp_path / "none")).read("bars").collect() == []
    table.merge(batch.limit(0), "s", 2)
    assert table.read().count() == 61


def test_the_first_prediction_stays_across_streams(spark, tmp_path):
    schema = "symbol string, dt date, y_prob double"
    day = dt.date(2024, 1, 2)
    for name, rows in {"a": [("A", day, 0.1), ("B", day, 0.2)], "b": [("A", day, 0.9), ("C", day, 0.3)]}.items():
        put(spark, rows, schema, tmp_path / name)
        flows.stream_predictions(flows.read_files(spark, f"{tmp_path}/{name}", schema), f"{tmp_path}/t", f"{tmp_path}/check-{name}")
    rows = flows.prediction_table(spark, f"{tmp_path}/t").read().collect()
    assert sorted((r.symbol, r.y_prob) for r in rows) == [("A", 0.1), ("B", 0.2), ("C", 0.3)]


def test_outcomes_of_later_batches_and_never(spark, tmp_path):
    ts = [dt.datetime(2024, m, 1) for m in range(1, 9)] + [dt.datetime(2100, 1, 1)]
    for k in range(len(ts) + 1):
        mark = k == len(ts)
        put(spark, [("", ts[-1], 0.0)] if mark else [("A", ts[k], k / 10)] if k < len(ts) - 1 else [], "symbol string, ts timestamp, y_prob double", tmp_path / "p")
        late = k - 2  # two batches after its prediction; number 3 never comes
        put(spark, [("", ts[-1], 0.0, 0)] if mark else [("A", ts[late], 1.0 * late, 1)] if late >= 0 and late != 3 else [],
            "symbol string, ts timestamp, ret_net double, win int", tmp_path / "o")
    # what is left arrives with the last predictions
    p = flows.read_files(spark, f"{tmp_path}/p", "symbol string, ts timestamp, y_prob double")
    o = flows.read_files(spark, f"{tmp_path}/o", "symbol string, ts timestamp, ret_net double, win int")
    flows.stream_matured(p, o, f"{tmp_path}/out", f"{tmp_path}/check", "100 days")
    got = {r.ts.month: (r.status, r.ret_net) for r in spark.read.parquet(f"{tmp_path}/out").filter("symbol <> ''").collect()}
    want = {k + 1: ("matured", 1.0 * k) if k not in (3, 7) else ("pending", None) for k in range(8)}
    assert got == want


@pytest.mark.parametrize("seed", [1])
def test_stream_rules_equal_batch_rules_with_late_files(spark, tmp_path, seed):
    rng = random.Random(seed)
    bars, start = [], dt.date(2020, 1, 1)
    for symbol in "ABCD":
        day, price = start, 50.0
        while day < start + dt.timedelta(days=360):
            price *= rng.choice([0.5, 0.9, 1.0, 1.1, 1.6])
            low, high = price * rng.choice([0.9, 1.1]), price * 1.05
            bars.append((symbol, day, price, high, low, price, price, rng.choice([0, 5, None])))
            day += dt.timedelta(days=rng.choice([1, 1, 2, 15]))
    files = {}
    for b in bars:
        k = (b[1] - start).days // 30 + (rng.random() < 0.2)
        files.setdefault(k, []).append(b)
    for k in sorted(files):
        rng.shuffle(files[k])
        put(spark, files[k], BAR, tmp_path / "in")
    put(spark, [(None, dt.date(2100, 1, 1), *[None] * 6)], BAR, tmp_path / "in")
    assert len(files) >= 12
    flows.stream_dq(flows.read_files(spark, f"{tmp_path}/in", BAR), f"{tmp_path}/out", f"{tmp_path}/check", "60 days")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want = quality.dq_issues(spark.createDataFrame(bars, BAR).fillna(0, ["volume"])).collect()

    def key(rows):
        return sorted((r.symbol, r.dt, r.severity, r.issue, round(r.detail, 9)) for r in rows)

    assert key(got) == key(want) and {r.issue for r in got} == {"ohlc_ordering", "zero_volume", "extreme_move", "calendar_gap"}
