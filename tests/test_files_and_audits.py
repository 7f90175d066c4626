"""Sources from files, the stored panel, frozen manifests and look-ahead audits on small inputs."""

import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from tapeaudit.functions import sym_order
from tapeaudit.operators import audit, freeze
from tapeaudit.sources import panel_cache, readers

D = dt.date
HEAD = "symbol,dt,open,high,low,close,adj_close,volume\n"


def test_bad_lines_are_kept_apart(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as fh:
        fh.write(HEAD + "a,2020-01-02,1,2,1,2,2,10\na,2020-01-03,1,2,1,n/a,2,10\na,2020-01-06\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as fh:
        fh.write(HEAD + "b,2020-13-45,1,2,1,2,2,10\n,2020-01-02,1,2,1,2,2,10\nb,2020-01-02,1,2,1,2,2,10,11\nb,2020-01-03,1,2,1,,2,10\n")
    rows, bad = readers.load_bars_csv(spark, str(tmp_path))
    assert sorted((r.symbol, r.dt, r.close) for r in rows.collect()) == [("a", D(2020, 1, 2), 2.0), ("b", D(2020, 1, 3), None)]
    got = {(r.file, r.line) for r in bad.collect()}
    assert got == {
        ("a.csv.gz", "a,2020-01-03,1,2,1,n/a,2,10"), ("a.csv.gz", "a,2020-01-06"), ("b.csv.gz", "b,2020-13-45,1,2,1,2,2,10"),
        ("b.csv.gz", "b,2020-01-02,1,2,1,2,2,10,11"), (None, ",2020-01-02,1.0,2.0,1.0,2.0,2.0,10"),
    }
    # whatever columns a query uses, the same lines are bad
    assert rows.select("symbol").count() == 2 and bad.select("file").count() == 5


def test_empty_and_missing_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text(HEAD)
    rows, bad = readers.load_bars_csv(spark, str(tmp_path / "e.csv"))
    assert rows.count() == bad.count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.load_bars_csv(spark, str(tmp_path / "none.csv"))


def test_filing_tables(spark, tmp_path):
    (tmp_path / "s").write_text("ACCESSION_NUMBER\tFILING_DATE\tDOCUMENT_TYPE\tISSUERTRADINGSYMBOL\n1\t05-JAN-2020\t4\tbrk.b\n2\t05-JAN-2020\n")
    (tmp_path / "t").write_text("ACCESSION_NUMBER\tTRANS_DATE\tTRANS_CODE\tTRANS_SHARES\tTRANS_PRICEPERSHARE\n1\t03-JAN-2020\tP\t5\tbad\n1\t03-JAN-2020\tA\t5\t1\n1\tx\ty\tz\tu\tv\n")
    (tmp_path / "o").write_text("ACCESSION_NUMBER\tRPTOWNERNAME\tRPTOWNER_RELATIONSHIP\n")
    rows, bad = readers.load_filings_tsv(spark, *[str(tmp_path / n) for n in "sto"])
    one = rows.collect()
    assert len(one) == 1 and one[0].symbol == "BRK-B" and one[0].price is None and one[0].owner is None
    assert sorted((r["table"], r.line) for r in bad.collect()) == [("submission", "2\t05-JAN-2020"), ("transactions", "1\tx\ty\tz\tu\tv")]


def test_stored_panel(spark, tmp_path):
    path = str(tmp_path / "panel")
    full = spark.createDataFrame([("a", D(2020, 1, 2), 1.0, 2.0), ("b", D(2020, 1, 2), None, 4.0)], "symbol string, dt date, x double, y double")
    calls = []

    def build(missing):
        calls.append(missing)
        return full.select("symbol", "dt", *missing)

    assert panel_cache.published(spark, path).count() == 0
    # an interrupted build: rows were written, the manifest was not
    full.limit(1).write.parquet(path + "/data/version=0")
    assert panel_cache.stored_panel(spark, path, ["x"], build).count() == 2
    panel_cache.stored_panel(spark, path, ["x", "symbol"], build)
    assert calls == [["x"]]
    both = panel_cache.stored_panel(spark, path, ["y"], build)
    assert calls == [["x"], ["y"]] and sorted(both.columns) == ["dt", "symbol", "x", "y"]
    assert sorted(both.select("symbol", "x", "y").collect()) == [("a", 1.0, 2.0), ("b", None, 4.0)]
    full.limit(1).write.parquet(path + "/data/version=2")
    assert panel_cache.stored_panel(spark, path, ["x", "y"], build).count() == 2 and len(calls) == 2
    panel_cache.stored_panel(spark, path, ["x"], build, rebuild=True)
    assert calls[-1] == ["x"] and [r.rows for r in panel_cache.published(spark, path).orderBy("number").collect()] == [2, 2, 2]


def test_frozen_manifest(spark, tmp_path):
    for name in ("a.sql", "b.sql"):
        (tmp_path / name).write_text("select 1")
    files = lambda: freeze.file_digests(spark.read.format("binaryFile").load(str(tmp_path)))
    spec = lambda *rows: spark.createDataFrame(rows, "version string, spec string, implemented_by array<string>")
    before = freeze.manifest(spec(("v1", "{}", ["b.sql", "a.sql"]), ("v2", "{}", ["a.sql"]), ("v3", "{}", []), ("v4", "{}", ["gone.sql"])), files())
    before = spark.createDataFrame(before.collect(), before.schema)
    again = freeze.manifest(spec(("v1", "{}", ["a.sql", "b.sql", "a.sql"]), ("v2", "{}", ["a.sql"]), ("v3", "{}", None), ("v4", "{}", ["gone.sql"])), files())
    assert all(r.intact and r.reasons == "" for r in freeze.verify(before, again).collect())
    (tmp_path / "b.sql").write_text("select 2")
    now = freeze.manifest(spec(("v1", "{}", ["a.sql", "b.sql"]), ("v2", '{"x":1}', ["a.sql", "b.sql"]), ("v4", "{}", ["gone.sql"]), ("v5", "{}", [])), files())
    got = {r.version: (r.intact, r.reasons) for r in freeze.verify(before, now).collect()}
    assert got == {
        "v1": (False, "file: b.sql"), "v2": (False, "specification; file: b.sql"), "v3": (False, "gone"), "v4": (True, ""), "v5": (False, "not frozen"),
    }


def test_audits_catch_a_leak(spark):
    bars = spark.createDataFrame([(s, D(2020, 1, d), float(d)) for s in "ab" for d in range(1, 9)], "symbol string, dt date, close double")
    w = sym_order(order="dt")
    layers = {
        "past": (lambda b: b.select("symbol", "dt", F.lag("close").over(w).alias("x")), ("symbol", "dt")),
        "future": (lambda b: b.select("symbol", "dt", F.lead("close").over(w).alias("x")), ("symbol", "dt")),
        "whole": (lambda b: b.join(b.agg(F.avg("close").alias("m"))).select("symbol", "dt", "m"), ("symbol", "dt")),
    }
    got = {(r.layer, r.cutoff.day): (r["rows"], r.differences) for r in audit.audit_layers(layers, bars, ["2020-01-03", "2020-01-08"]).collect()}
    assert got == {
        ("past", 3): (2, 0), ("future", 3): (2, 2), ("whole", 3): (2, 2), ("past", 8): (2, 0), ("future", 8): (2, 0), ("whole", 8): (2, 0),
    }
    assert audit.audit_labels_absent(layers["past"][0], bars, "2020-01-03", ["x"]).count() == 2
    assert audit.audit_labels_absent(layers["future"][0], bars, "2020-01-03", ["x"]).count() == 0


def test_filing_files_join_the_lines_once(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from tapeaudit.catalog import load
    from tapeaudit.catalog.base import Data

    written, write = [], DataFrameWriter.csv
    plan = lambda w: w._df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(DataFrameWriter, "csv", lambda self, *a, **k: written.append(plan(self)) or write(self, *a, **k))
    files = load._filing_files(Data(spark, "/root/testdata/sf0.001"))
    assert len(written) == 6 and not any("Join" in p for p in written)
    sub = spark.read.csv(files[0], sep="\t", header=True).filter("FILING_DATE is not null and DOCUMENT_TYPE in ('3', '4')")
    assert sub.count() == sub.distinct().count() > 1000


def test_filing_tables_are_not_stored(spark, tmp_path, monkeypatch):
    """The files are read where they are used, and what is a bad line does not depend on the columns used."""
    monkeypatch.setattr(readers, "cut", lambda df: pytest.fail("stored"))
    (tmp_path / "s").write_text("ACCESSION_NUMBER\tFILING_DATE\tDOCUMENT_TYPE\tISSUERTRADINGSYMBOL\n1\t05-JAN-2020\t4\tbrk.b\n2\t05-JAN-2020\t4\n3\t05-xyz-2020\t4\ta\n")
    (tmp_path / "t").write_text("ACCESSION_NUMBER\tTRANS_DATE\tTRANS_CODE\tTRANS_SHARES\tTRANS_PRICEPERSHARE\n" + "".join(f"{i}\t03-JAN-2020\tP\t5\t1\n" for i in (1, 2, 3)))
    (tmp_path / "o").write_text("ACCESSION_NUMBER\tRPTOWNERNAME\tRPTOWNER_RELATIONSHIP\n1\tb\tx\n1\ta\ty\n1\ta\tx\tz\n")
    for n in (None, 10):
        rows, bad = readers.load_filings_tsv(spark, *[str(tmp_path / n) for n in "sto"], rows=n)
        assert [(r.symbol, r.filing_date, r.owner, r.relationship) for r in rows.collect()] == [("BRK-B", D(2020, 1, 5), "a", "y")]
        assert rows.select("price").count() == 1 and bad.select("file").count() == bad.count() == 2
    rows, bad = readers.read_lines(spark, str(tmp_path / "s"), "a int, d string, t int, s int", stored=False, sep="\t")
    assert rows.select("a").count() == rows.count() == 0 and bad.select("file").count() == 3


def test_filings_are_shuffled_once_into_tasks_by_rows(spark, monkeypatch):
    import os

    from tapeaudit.catalog import load
    from tapeaudit.catalog.base import Data
    from tapeaudit.functions import lineage

    monkeypatch.setattr(lineage, "LINES_PER_TASK", 100)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    lines, cut = [], load.cut
    monkeypatch.setattr(load, "cut", lambda df: lines.append(df) or cut(df))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = Data(spark, "/root/testdata/sf0.001")
        files = load._filing_files(d)
        # the lines and the parts; telling filings apart shuffles nothing more
        assert plan(lines[0]).count("Exchange hashpartitioning(l_partkey") == plan(lines[0]).count("Exchange") == 2
        assert lines[0].rdd.getNumPartitions() >= d.line_rows // 100 > 50  # the session has 4 shuffle partitions
        assert {n[-7:] for f in files for n in os.listdir(f) if n.startswith("part-")} == {".csv.gz"}
        rows = readers.load_filings_tsv(spark, *files, rows=d.line_rows)[0]
        assert plan(rows).count("Exchange hashpartitioning(accession") == plan(rows).count("Exchange") == 3
        assert rows.rdd.getNumPartitions() >= d.line_rows // 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
