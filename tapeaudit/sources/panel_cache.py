"""A stored panel that studies share: written aside, published last, reused while it has what is asked for.

Layout: `data/version=N` holds the rows of version N and `manifest/version=N` one line with its schema and row count.
A version counts once its manifest is there; what an interrupted build left behind is never read and is overwritten by
the next build. Older versions stay for readers that are under way. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "number int, schema string, keys array<string>, rows bigint"


def published(spark: SparkSession, path: str) -> DataFrame:
    """One line per version of the panel at `path`; none where nothing was published."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("number", "schema", "keys", "rows")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _read(spark: SparkSession, path: str, line) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(json.loads(line.schema))).parquet(f"{path}/data/version={line.number}")


def _publish(df: DataFrame, path: str, number: int, keys: Sequence[str]) -> DataFrame:
    spark, where = df.sparkSession, f"{path}/data/version={number}"
    df.write.mode("overwrite").parquet(where)
    stored = spark.read.schema(df.schema).parquet(where)
    said = stored.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(number).alias("number"), F.lit(df.schema.json()).alias("schema"), F.array(*[F.lit(k) for k in keys]).alias("keys"), "rows"
    )
    said.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={number}")
    return stored


def stored_panel(
    spark: SparkSession, path: str, needed: Sequence[str], build: Callable[[list[str]], DataFrame],
    keys: Sequence[str] = ("symbol", "dt"), rebuild: bool = False,
) -> DataFrame:
    """The panel at `path` with at least the keys and the columns `needed`.

    Where the newest version has all of them it is read, and `build` is not called. Where some are missing,
    `build(missing)` gives the keys and these columns, and a version with both is published: one join by key, the
    columns already there are not computed again. Rows that only one side has stay, with nulls. With `rebuild`, or
    where nothing is stored yet or under other keys, everything is built.
    """
    keys = list(keys)
    line = published(spark, path).orderBy(F.desc("number")).first()
    number = 0 if line is None else line.number + 1
    wanted = [c for c in needed if c not in keys]
    if line is None or rebuild or list(line.keys) != keys:
        return _publish(build(wanted).select(*keys, *wanted), path, number, keys)
    have = _read(spark, path, line)
    missing = [c for c in wanted if c not in have.columns]
    if not missing:
        return have
    return _publish(have.join(build(missing).select(*keys, *missing), keys, "full"), path, number, keys)
