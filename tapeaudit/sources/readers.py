"""Readers for the file formats of the sources, and the two sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import cut, dealt, lineage


def read_lines(spark: SparkSession, path, ddl: str, stored: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """Rows of delimited (gzip) files with a header, and the lines that do not fit the schema, as (file, line).

    Too few or too many fields, and fields that are not of their type, make a bad line; none is dropped silently.
    Gzip cannot be split, so a file is one task; the rows are stored once as Parquet in the shared folder, which
    later steps read in splits. With `stored=False` nothing is stored: rows and bad lines each read the files when they
    are used. All columns are read in both ways, so what counts as bad does not depend on the columns that a query happens to use.
    """
    reader = spark.read.schema(f"{ddl}, _line string").options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_line", **options)
    parsed = reader.csv(path)
    # a condition that every line meets keeps the columns that a query does not use from being pruned
    whole = F.hash(*parsed.columns) <= 2**31 - 1
    parsed = parsed.select("*", F.col("_metadata.file_name").alias("_file"))
    parsed = cut(parsed) if stored else parsed.filter(whole)
    return parsed.filter("_line is null").drop("_line", "_file"), parsed.filter("_line is not null").select(
        F.col("_file").alias("file"), F.col("_line").alias("line")
    )


def load_bars_csv(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Bars from (gzip) CSV, and bad lines.  A bar without symbol or date is a bad line, too."""
    rows, bad = read_lines(spark, path, schemas.BARS)
    keyed = F.col("symbol").isNotNull() & F.col("dt").isNotNull()
    text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
    return rows.filter(keyed), bad.unionByName(rows.filter(~keyed).select(F.lit(None).cast("string").alias("file"), text.alias("line")))


def read_bars_csv(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """Bars from (gzip) CSV without the bad lines; `parts` spreads the rows by key."""
    df, _ = load_bars_csv(spark, path)
    return df.repartition(parts, "symbol", "dt") if parts else df


def read_universe_csv(spark: SparkSession, path: str) -> DataFrame:
    """Symbols from CSV.  A symbol listed twice fails the job when the rows are read;
    a missing column fails on read because the header is enforced."""
    df = (
        spark.read.schema(schemas.SYMBOLS)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return guard_unique(df, "symbol")


def guard_unique(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows; raises inside the job when a key occurs twice."""
    cols = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in cols]
    )
    msg = F.concat(F.lit("duplicate key: "), F.concat_ws(",", *keys))
    ok = F.when(F.col("_n") > 1, F.raise_error(msg).cast("boolean")).otherwise(F.lit(True))
    return one.filter(ok).select(*df.columns)


def read_panel(spark: SparkSession, path: str, columns, min_adv: float | None = None) -> DataFrame:
    """Only the columns asked for, and the liquidity filter, reach the Parquet scan."""
    df = spark.read.parquet(path).select(*dict.fromkeys([*columns, "adv"]))
    return df if min_adv is None else df.filter(F.col("adv") >= min_adv)


# the columns used of the three tables of a filing batch
SUBMISSION = "ACCESSION_NUMBER string, FILING_DATE string, DOCUMENT_TYPE string, ISSUERTRADINGSYMBOL string"
TRANSACTIONS = "ACCESSION_NUMBER string, TRANS_DATE string, TRANS_CODE string, TRANS_SHARES string, TRANS_PRICEPERSHARE string"
OWNERS = "ACCESSION_NUMBER string, RPTOWNERNAME string, RPTOWNER_RELATIONSHIP string"


def load_filings_tsv(spark: SparkSession, submission, transactions, owners, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Three tab-separated tables of one filing batch joined to one row per trade, and the bad lines as
    (table, file, line).  A table that is not there fails at once.  `rows`, about the lines of the longest table, sets the tasks
    of the join.  The lines are read once by the join, and again where the bad ones are asked for, too; they are not stored."""
    given = {"submission": (submission, SUBMISSION), "transactions": (transactions, TRANSACTIONS), "owners": (owners, OWNERS)}
    read = {name: read_lines(spark, path, ddl, stored=False, sep="\t") for name, (path, ddl) in given.items()}
    bad = [lines.select(F.lit(name).alias("table"), "file", "line") for name, (_, lines) in read.items()]
    return join_filings(*[good for good, _ in read.values()], rows), reduce(DataFrame.unionByName, bad)


def read_filings_tsv(spark: SparkSession, submission: str, transactions: str, owners: str) -> DataFrame:
    return load_filings_tsv(spark, submission, transactions, owners)[0]


def join_filings(sub: DataFrame, trans: DataFrame, own: DataFrame, rows: int | None = None) -> DataFrame:
    """Form 4 purchases and sales with the filing's first owner.  Fields become values before the join, so that these are shuffled
    and not texts."""
    # months are read in upper and lower case
    day = lambda c: F.try_to_timestamp(F.col(c), F.lit("dd-MMM-yyyy")).cast("date")
    num = lambda c: F.col(c).try_cast("double")
    acc = F.col("ACCESSION_NUMBER").alias("accession")
    filings = sub.filter((F.col("DOCUMENT_TYPE") == "4") & F.col("ISSUERTRADINGSYMBOL").isNotNull()).select(
        acc,
        F.translate(F.upper(F.trim("ISSUERTRADINGSYMBOL")), ".", "-").alias("symbol"),
        day("FILING_DATE").alias("filing_date"),
    )
    trades = trans.filter(F.col("TRANS_CODE").isin("P", "S")).select(
        acc,
        day("TRANS_DATE").alias("trans_date"),
        F.col("TRANS_CODE").alias("trans_code"),
        num("TRANS_SHARES").alias("shares"),
        num("TRANS_PRICEPERSHARE").alias("price"),
    )
    owners = own.select(acc, "RPTOWNERNAME", "RPTOWNER_RELATIONSHIP")
    tables = (filings.filter(F.col("filing_date").isNotNull()), trades, owners)
    filings, trades, owners = (dealt(df, rows, "accession", per_task=lineage.LINES_PER_TASK) for df in tables)
    first_owner = owners.groupBy("accession").agg(F.min(F.struct("RPTOWNERNAME", "RPTOWNER_RELATIONSHIP")).alias("o"))
    return (
        trades.join(filings, "accession")
        .join(first_owner, "accession", "left")
        .select(
            "accession",
            "symbol",
            "filing_date",
            "trans_date",
            "trans_code",
            "shares",
            "price",
            F.col("o.RPTOWNERNAME").alias("owner"),
            F.col("o.RPTOWNER_RELATIONSHIP").alias("relationship"),
        )
    )


FACT_UNITS = ("USD", "shares")
FACT_FORMS = ("10-K", "10-Q")


def flatten_facts(docs: DataFrame, concepts=None, units=FACT_UNITS, forms=FACT_FORMS) -> DataFrame:
    """(symbol, json) with namespace -> concept -> unit -> records, to one row per record.

    When two namespaces hold a concept, the first in name order wins.
    """
    j = docs.select("symbol", F.from_json("json", schemas.FACTS_JSON).alias("j"))
    ns = j.select("symbol", F.explode("j.facts").alias("namespace", "body"))
    con = ns.select("symbol", "namespace", F.explode("body").alias("concept", "c"))
    if concepts is not None:
        con = con.filter(F.col("concept").isin(*concepts))
    first = con.groupBy("symbol", "concept").agg(F.min_by("c", "namespace").alias("c"))
    unit = first.select("symbol", "concept", F.explode("c.units").alias("unit", "records"))
    rec = unit.filter(F.col("unit").isin(*units)).select(
        "symbol", "concept", "unit", F.explode("records").alias("r")
    )
    return rec.filter(
        F.col("r.form").isin(*forms)
        & F.col("r.end").isNotNull()
        & F.col("r.filed").isNotNull()
        & F.col("r.val").isNotNull()
    ).select(
        "symbol",
        "concept",
        "unit",
        F.to_date("r.start").alias("period_start"),
        F.to_date("r.end").alias("period_end"),
        F.to_date("r.filed").alias("filed"),
        F.col("r.val").alias("val"),
        F.col("r.form").alias("form"),
    )


def write_report(df: DataFrame, path: str) -> None:
    """A tidy report as CSV.  Reports are aggregates; the writer still uses every
    partition, so a large one is several files rather than one task."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_bars(df: DataFrame, path: str) -> None:
    """Bars as Parquet by year, so that date filters prune directories."""
    (
        df.withColumn("year", F.year("dt"))
        .repartition("year", "symbol")
        .sortWithinPartitions("symbol", "dt")
        .write.mode("overwrite")
        .partitionBy("year")
        .parquet(path)
    )
