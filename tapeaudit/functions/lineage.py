"""Cutting lineage where one table feeds several branches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

#: Rows that a task of a wide stage (several sorts over some 20 columns, about 2 KB of memory a row) gets on average.
ROWS_PER_TASK = 200_000
#: The same for lines of a few short fields (one or two sorts, some 100 bytes a row): fewer and larger tasks, as the pieces of a
#: shuffle compress the worse the more there are.
LINES_PER_TASK = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir; a session without one (a
    test on one machine) gets a temporary folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-tables-")
    return _own[app]


def dealt(df: DataFrame, rows: int | None, *keys: str, per_task: int | None = None) -> DataFrame:
    """`df`, of about `rows` rows, dealt by `keys` over as many tasks as keep each near `per_task` (ROWS_PER_TASK) rows, whatever
    the session's shuffle partitions are, in whole rounds of the session's cores; unknown `rows` leave it as it is."""
    if rows is None:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    rounds = max(1, -(-rows // ((per_task or ROWS_PER_TASK) * cores)))
    return df.repartition(rounds * cores, *keys)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it from there.

    The branches that follow prune columns, see the real size, and do not recompute
    what lies before; a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
