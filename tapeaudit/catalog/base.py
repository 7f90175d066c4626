"""Query registry and the lazily built inputs the queries share."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar, features, labels, quality
from ..functions import cut
from ..functions.core import ROUND_AT
from ..sources import panels

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


class Data:
    """Inputs of one scale directory; every property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return panels.table(self.spark, self.dir, name)

    @cached_property
    def bars(self):
        """The stored bar table: at most one row per symbol and session, read by many branches."""
        return cut(panels.bars(self.spark, self.dir))

    @cached_property
    def symbols(self):
        return panels.symbols(self.spark, self.dir)

    @cached_property
    def calendar(self):
        return calendar.trading_calendar(self.bars)

    @cached_property
    def ix(self):
        return calendar.index_bars(self.bars, self.calendar, self.symbols)

    @cached_property
    def features(self):
        return features.features(self.ix)

    @cached_property
    def labels(self):
        return labels.labels(self.ix)

    @cached_property
    def names(self) -> int:
        """Bound on the symbols of one date (distinct brands)."""
        return self.symbols.count()

    @cached_property
    def wide_names(self) -> int:
        return panels.wide_width(self.spark, self.dir)

    @cached_property
    def panel(self):
        return features.feature_panel(self.features, features.market_state(self.features), self.names)

    @cached_property
    def line_rows(self) -> int:
        """Rows of the line items (Parquet metadata)."""
        return self.table("lineitem").count()

    @cached_property
    def wbars(self):
        return cut(panels.wide_bars(self.spark, self.dir))

    @cached_property
    def wide_rows(self) -> int:
        """Rows of the weekly bars (Parquet metadata)."""
        return self.wbars.count()

    @cached_property
    def wsymbols(self):
        """Stored: the planner sees the size of the file instead of a guess for the join of three tables."""
        return cut(panels.wide_symbols(self.spark, self.dir))

    @cached_property
    def wcalendar(self):
        return calendar.trading_calendar(self.wbars)

    @cached_property
    def wix(self):
        return calendar.index_bars(self.wbars, self.wcalendar, self.wsymbols, self.wide_rows)

    @cached_property
    def earnings(self):
        return calendar.resolve_tradeable_from(panels.earnings(self.spark, self.dir), self.calendar)

    @cached_property
    def actions(self):
        return quality.dedupe_actions(panels.contracts(self.spark, self.dir))


def query(name: str, sql: str | None = None):
    """Register fn(Data) -> DataFrame under `name`, with its oracle if there is one."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Data(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def oracle(final: str) -> str:
    """Prefix `final` with the common table expressions it mentions (x_...)."""
    order: list[str] = []
    seen: set[str] = set()
    final = _settle(final)

    def visit(text):
        for name in re.findall(r"\bx_\w+", text):
            if name in CTES and name not in seen:
                seen.add(name)
                visit(CTES[name])
                order.append(name)

    visit(final)
    if not order:
        return final
    # recursive expressions declare their columns in the name
    recursive = "RECURSIVE " if any("/*recursive*/" in CTES[n] for n in order) else ""
    # materialised: each shared step is evaluated once, however often it is used
    how = {n: "" if "/*recursive*/" in CTES[n] else "MATERIALIZED " for n in order}
    ctes = ",\n".join(f"{n} AS {how[n]}(\n{_settle(CTES[n])}\n)" for n in order)
    if final.lstrip().upper().startswith("WITH "):
        return f"WITH {recursive}{ctes},\n{final.lstrip()[5:]}"
    return f"WITH {recursive}{ctes}\n{final}"


def _settle(sql: str) -> str:
    """Rewrite round(x, d)+0.0 into the rounding that functions.tidy uses."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        depth, end, comma = 0, at + 5, -1
        while True:
            ch = sql[end]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = end
            if depth == 0:
                break
            end += 1
        tail = re.match(r"\)\s*\+\s*0\.0", sql[end:])
        if tail is None:
            at += 6
            continue
        inner, digits = sql[at + 6 : comma], int(sql[comma + 1 : end])
        new = f"(floor(({inner})*1e{digits}+{ROUND_AT})/1e{digits})"
        sql = sql[:at] + new + sql[end + tail.end() :]
    return sql


def oracles() -> dict[str, str]:
    return {name: oracle(sql) for name, sql in ORACLES.items()}


def r(names: str, digits: int = 6) -> str:
    """Select list that rounds each named column."""
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names.split())


def rounded(df: DataFrame, digits: int = 6, **per) -> DataFrame:
    from ..functions import tidy

    return tidy(df, digits, **per)


__all__ = ["CTES", "Data", "F", "ORACLES", "QUERIES", "oracles", "query", "r", "rounded"]
