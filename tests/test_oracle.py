"""Registered queries against their SQL oracles.

ORACLE_SF picks the scale (default 0.001) and ORACLE_ALL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as entry
import oracle

SF_DIR = f"/root/testdata/sf{os.environ.get('ORACLE_SF', '0.001')}"
QUICK = [
    "src_bars", "upsert_latest", "validate_trades", "trading_calendar", "asof_backward", "lag_sessions", "resolve_entity",
    "momentum", "labels", "expanding_z", "xs_percent_rank_unbounded", "trial_count", "chain_verify", "p_adjust", "journal_stats",
    "stream_dq",
]
Q, O = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", list(Q) if os.environ.get("ORACLE_ALL") else QUICK)
def test_query(spark, con, name):
    df = Q[name](spark, SF_DIR)
    if name in O:
        diff = oracle.compare(df, con, O[name])
        assert diff is None, diff
    else:
        df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_partitioning_does_not_change_results(spark, con):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 7, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert oracle.compare(Q["momentum"](spark, SF_DIR), con, O["momentum"]) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_every_oracle_has_a_query():
    assert set(O) <= set(Q)
