"""Frozen strategies: a manifest of digests over a specification and the files that implement it, and its check.

A record that was made under a frozen version is worth nothing once the specification or a file has changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST = "version string, spec_sha256 string, sources array<struct<name string, sha256 string>>, code_sha256 string"


def file_digests(files: DataFrame, name=None) -> DataFrame:
    """(name, sha256) of files of the binaryFile source; contents are digested where they are read.

    `name` defaults to the last part of the path.
    """
    name = F.element_at(F.split("path", "/"), -1) if name is None else name
    return files.select(name.alias("name"), F.sha2("content", 256).alias("sha256"))


def manifest(specs: DataFrame, digests: DataFrame) -> DataFrame:
    """One line per version. `specs`: version, spec (its text), implemented_by (names of files).

    The code digest covers the text and the digests of its files by name. A file that is not there has a null digest.
    """
    named = specs.select("version", "spec", F.explode_outer(F.array_distinct("implemented_by")).alias("name"))
    found = named.join(digests, "name", "left").groupBy("version", "spec").agg(
        F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "sha256")))).alias("sources")
    )
    listed = F.transform("sources", lambda s: F.concat_ws("=", s["name"], F.coalesce(s["sha256"], F.lit("missing"))))
    return found.select(
        "version", F.sha2("spec", 256).alias("spec_sha256"), "sources",
        F.sha2(F.concat_ws("\n", F.col("spec"), F.array_join(listed, "\n")), 256).alias("code_sha256"),
    )


def verify(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """Each version of either manifest: is it intact, and if not, what changed.

    reasons (joined by "; "): not frozen, gone, specification, then `file: name` of changed, missing and added files.
    """
    a = frozen.select("version", F.struct("spec_sha256", "sources", "code_sha256").alias("a"))
    b = now.select("version", F.struct("spec_sha256", "sources", "code_sha256").alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    odd = F.array_union(F.array_except("a.sources", "b.sources"), F.array_except("b.sources", "a.sources"))
    files = F.transform(F.array_sort(F.array_distinct(F.transform(odd, lambda s: s["name"]))), lambda n: F.concat(F.lit("file: "), n))
    whole = F.array_compact(F.array(
        F.when(F.col("a").isNull(), "not frozen"), F.when(F.col("b").isNull(), "gone"),
        F.when(both & (F.col("a.spec_sha256") != F.col("b.spec_sha256")), "specification"),
    ))
    why = F.concat(whole, F.when(both, files).otherwise(F.array().cast("array<string>")))
    return a.join(b, "version", "full").select(
        "version", F.coalesce(F.col("a.code_sha256") == F.col("b.code_sha256"), F.lit(False)).alias("intact"),
        F.array_join(why, "; ").alias("reasons"),
    )
