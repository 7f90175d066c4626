"""Small helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything but a-z, 0-9 and what lies beyond ASCII, as a Java pattern on text that may still have capitals.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of a side that may be broadcast (ids or short terms: about 64 MB at most).
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; `lower` does just that, and faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The contract's words of a text, capitals kept: spans are the same before and after lower-casing."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != "")


def row_key(id_col: str, text: Column, prefix: str = "__row") -> list[Column]:
    """Two non-null join keys of a row, so that rows which share an id, or have none, stay apart unless
    their texts are equal too."""
    i = F.col(id_col)
    return [
        F.coalesce(i.cast("string"), F.lit("")).alias(f"{prefix}_id"),
        F.xxhash64(i.isNull(), text).alias(f"{prefix}_fp"),
    ]


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Each of `names`, with underscores in front until no column of `docs` is called so (case counts for nothing)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `rows` rows; reads no more than it needs for the answer."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint when its measured size allows that; otherwise the join shuffles."""
    return F.broadcast(df) if small_enough(df, rows) else df


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where `use` names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), 0)
