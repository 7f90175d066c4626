"""Reproducible uniforms: a hash of the row's own key, not a stateful generator.

A lost executor recomputes the same numbers, and any SQL engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts) -> Column:
    """Uniform in [0, 1) from the md5 of the parts joined by '-'."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    digest = F.md5(F.concat_ws("-", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def bound(p: Column) -> Column:
    """What `below` compares with for a probability p below 1."""
    return F.lower(F.lpad(F.hex(F.ceil(p * F.lit(4294967296.0)).cast("bigint")), 8, "0"))


def below(limit: Column, *parts) -> Column:
    """uniform(*parts) < p, where limit = bound(p), told from the digest's text without making a number of it."""
    cols = [F.col(x) if isinstance(x, str) else x for x in parts]
    return F.substring(F.md5(F.concat_ws("-", *[c.cast("string") for c in cols])), 1, 8) < limit
