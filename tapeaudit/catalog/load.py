"""Queries of the loading layer: sources, normalising, quality, accounting."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cut, dealt, lineage, sym_order
from ..functions.lineage import shared_dir
from ..operators import calendar, entities, quality
from ..sources import panel_cache, panels, readers
from . import ctes  # noqa: F401
from .base import CTES, query, r, rounded

PX = "open high low close adj_close"


def _folder(d) -> str:
    return f"{shared_dir(d.spark)}/{uuid.uuid4().hex}"


def _bar_files(d) -> str:
    """The bars as gzip CSV with a header, as they are downloaded, with lines that are no bars: a price that is not a
    number, a month that does not exist, and lines cut off after three fields."""
    where = _folder(d)
    out = {"header": True, "compression": "gzip", "mode": "append"}
    text = d.bars.select("symbol", *[F.col(c).cast("string") for c in ("dt", *PX.split(), "volume")])
    text.write.csv(where, **out)
    word = text.filter("volume % 97 = 0").withColumn("close", F.lit("n/a"))
    month = text.filter("volume % 89 = 0").withColumn("dt", F.lit("1999-13-45"))
    word.unionByName(month).write.csv(where, **out)
    text.filter("volume % 83 = 0").select("symbol", "dt", "open").write.csv(where, **out)
    return where


@query("src_bars", f"SELECT symbol, dt, {r(PX)}, volume FROM x_bars")
def src_bars(d):
    """Bars read from gzip CSV files, without the lines that are no bars."""
    return rounded(readers.load_bars_csv(d.spark, _bar_files(d))[0])


@query(
    "src_bars_bad_lines",
    """SELECT symbol, kind, count(*) AS lines FROM (
SELECT symbol, CASE n WHEN 97 THEN 'price' WHEN 89 THEN 'date' ELSE 'cut off' END AS kind FROM x_bars, (VALUES (97),(89),(83)) v(n) WHERE volume % n = 0) GROUP BY 1, 2""",
)
def src_bars_bad_lines(d):
    """What was wrong with the lines of the files, by symbol."""
    bad = readers.load_bars_csv(d.spark, _bar_files(d))[1]
    kind = F.when(F.col("line").contains("n/a"), "price").when(F.col("line").contains("1999-13-45"), "date").otherwise("cut off")
    return bad.groupBy(F.split("line", ",")[0].alias("symbol"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("lines"))


@query("src_universe", "SELECT * FROM x_symbols")
def src_universe(d):
    where = _folder(d)
    d.symbols.write.csv(where, header=True)
    return readers.read_universe_csv(d.spark, where)


@query(
    "src_parquet_pruned",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice,6)+0.0 AS l_extendedprice, "
    "round(l_quantity*l_extendedprice,4)+0.0 AS adv FROM lineitem WHERE l_extendedprice >= 50000",
)
def src_parquet_pruned(d):
    li = d.table("lineitem").filter(F.col("l_extendedprice") >= 50000)
    return rounded(
        li.select(
            "l_orderkey", "l_linenumber", "l_extendedprice",
            (F.col("l_quantity") * F.col("l_extendedprice")).alias("adv"),
        ),
        adv=4,
    )


# three "files" of one filing batch, cut from the line items
CTES["x_filings"] = """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS acc, lower(p_brand) AS tick,
  l_linenumber, l_shipdate, l_returnflag, l_quantity, l_extendedprice, l_suppkey, l_orderkey
FROM lineitem JOIN part ON l_partkey=p_partkey"""


@query(
    "src_tsv_join3",
    """
WITH s AS (SELECT DISTINCT acc, replace(upper(tick), '.', '-') AS symbol,
             CAST(l_shipdate AS DATE) + l_linenumber AS filing_date
           FROM x_filings WHERE l_orderkey % 3 <> 0),
t AS (SELECT acc, CAST(l_shipdate AS DATE) AS trans_date, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' END AS trans_code,
        CASE WHEN l_orderkey % 10 <> 1 THEN l_quantity END AS shares, l_extendedprice AS price FROM x_filings WHERE l_returnflag <> 'N'),
w AS (SELECT acc, min('OWN' || l_suppkey) AS owner FROM x_filings WHERE l_orderkey % 4 <> 0 GROUP BY acc)
SELECT t.acc AS accession, symbol, filing_date, trans_date, trans_code, shares, round(price,6)+0.0 AS price, owner,
  CASE WHEN owner IS NULL THEN NULL ELSE 'Director' END AS relationship
FROM t JOIN s USING (acc) LEFT JOIN w USING (acc)""",
)
def src_tsv_join3(d):
    return rounded(readers.load_filings_tsv(d.spark, *_filing_files(d), rows=d.line_rows)[0])


@query(
    "src_tsv_bad_lines",
    """SELECT 'submission' AS "table", count(*) AS lines FROM x_filings WHERE l_orderkey % 50 = 7
UNION ALL SELECT 'transactions', count(*) FROM x_filings WHERE l_orderkey % 50 = 9 UNION ALL SELECT 'owners', count(*) FROM x_filings WHERE l_orderkey % 50 = 11""",
)
def src_tsv_bad_lines(d):
    """Lines with too few or too many fields in the three tables of a filing batch."""
    bad = readers.load_filings_tsv(d.spark, *_filing_files(d))[1]
    return bad.groupBy("table").agg(F.count(F.lit(1)).alias("lines"))


def _filing_files(d) -> list[str]:
    """The three tables of a filing batch as tab-separated gzip files, with lines that are cut off or have a field too many."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = d.table("lineitem").select(*key, F.col("l_shipdate").cast("date").alias("ship"), "l_returnflag", "l_quantity", "l_extendedprice")
    part = d.table("part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_brand").alias("brand"))
    # lines are dealt once: those of a filing are of one part, so they meet in the task that joins the part, with its few parts hashed
    li = dealt(li, d.line_rows, "l_partkey", per_task=lineage.LINES_PER_TASK).join(part.hint("shuffle_hash"), "l_partkey")
    filing = Window.partitionBy(*key, "ship", "brand").orderBy("ship")
    # read by six writers
    li = cut(li.withColumn("nth", F.row_number().over(filing)))
    acc = F.concat_ws("-", *key).alias("ACCESSION_NUMBER")
    day = lambda c: F.upper(F.date_format(c, "dd-MMM-yyyy"))
    # one line per filing
    sub = li.filter("nth = 1").select(
        acc,
        day(F.date_add("ship", F.col("l_linenumber"))).alias("FILING_DATE"),
        F.when(F.col("l_orderkey") % 3 == 0, "3").otherwise("4").alias("DOCUMENT_TYPE"),
        F.col("brand").alias("ISSUERTRADINGSYMBOL"),
    )
    trans = li.select(
        acc,
        day("ship").alias("TRANS_DATE"),
        F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S").otherwise("M")
        .alias("TRANS_CODE"),
        F.when(F.col("l_orderkey") % 10 == 1, "n/a").otherwise(F.col("l_quantity").cast("string"))
        .alias("TRANS_SHARES"),
        F.col("l_extendedprice").cast("string").alias("TRANS_PRICEPERSHARE"),
    )
    own = li.filter(F.col("l_orderkey") % 4 != 0).select(
        acc,
        F.concat(F.lit("OWN"), F.col("l_suppkey")).alias("RPTOWNERNAME"),
        F.lit("Director").alias("RPTOWNER_RELATIONSHIP"),
    )
    one = F.lit("x")
    broken = [
        li.filter("l_orderkey % 50 = 7").select(acc, one),
        li.filter("l_orderkey % 50 = 9").select(acc, *[one.alias(f"f{i}") for i in range(5)]),
        li.filter("l_orderkey % 50 = 11").select(acc),
    ]
    out, how = [], {"sep": "\t", "header": True, "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    for good, bad in zip((sub, trans, own), broken):
        out.append(_folder(d))
        good.write.options(**how).csv(out[-1])
        bad.write.options(**how).csv(out[-1], mode="append")
    return out


@query(
    "sink_parquet_cache",
    f"""SELECT symbol, dt, round(lead(adj_close,5) OVER w/adj_close-1.0,6)+0.0 AS fwd_5, round(lead(adj_close,21) OVER w/adj_close-1.0,6)+0.0 AS fwd_21,
 'symbol,dt,fwd_5 symbol,dt,fwd_5,fwd_21' AS versions FROM x_ix WINDOW w AS ({ctes.W})""",
)
def sink_parquet_cache(d):
    """A panel stored with one horizon, reused, and extended by another without computing the first again."""
    where, asked = _folder(d), []

    def build(missing):
        asked.append(missing)
        ahead = [(F.lead("adj_close", int(c[4:])).over(sym_order()) / F.col("adj_close") - 1.0).alias(c) for c in missing]
        return d.ix.select("symbol", "dt", *ahead)

    for needed in (["fwd_5"], ["fwd_5"], ["fwd_5", "fwd_21"]):
        panel = panel_cache.stored_panel(d.spark, where, needed, build)
    if asked != [["fwd_5"], ["fwd_21"]]:
        raise AssertionError(f"built {asked}")
    names = F.array_join(F.transform(F.from_json("schema", "fields array<struct<name string>>")["fields"], lambda f: f["name"]), ",")
    versions = panel_cache.published(d.spark, where).groupBy().agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", names.alias("n")))), lambda v: v["n"]), " ").alias("versions")
    )
    return rounded(panel.withColumn("_j", F.lit(1)).join(versions.withColumn("_j", F.lit(1)), "_j").drop("_j"))


@query("sink_report_csv", "SELECT symbol, count(*) AS bars, min(dt) AS first_dt, max(dt) AS last_dt FROM x_bars GROUP BY symbol")
def sink_report_csv(d):
    """A report written as CSV and read back."""
    where, report = _folder(d), quality.coverage(d.bars)
    readers.write_report(report, where)
    return d.spark.read.schema(report.schema).csv(where, header=True)


@query(
    "flatten_facts",
    """
SELECT symbol, concept, 'USD' AS unit, period_start, period_end, filed, round(val,2)+0.0 AS val, form
FROM x_facts WHERE concept <> 'CommonStockSharesOutstanding'""",
)
def flatten_facts(d):
    """Facts packed into one JSON document per filing date and symbol, then flattened again."""
    f = panels.fundamentals(d.spark, d.dir)
    rec = F.struct(
        F.col("period_start").cast("string").alias("start"),
        F.col("period_end").cast("string").alias("end"),
        "val",
        "form",
        F.col("filed").cast("string").alias("filed"),
    )
    packed = f.groupBy("symbol", "filed", "concept").agg(F.collect_list(rec).alias("rs"))
    unit = F.when(F.col("concept") == "CommonStockSharesOutstanding", "pure").otherwise("USD")
    body = F.struct(F.create_map(unit, "rs").alias("units"))
    docs = packed.groupBy("symbol", "filed").agg(
        F.map_from_entries(F.collect_list(F.struct("concept", body))).alias("m")
    )
    docs = docs.select(
        "symbol",
        F.to_json(F.struct(F.lit("1").alias("cik"), F.create_map(F.lit("us-gaap"), "m").alias("facts"))).alias("json"),
        F.col("filed").alias("doc"),
    )
    # one document per (symbol, day): the first-namespace rule applies inside a document
    keyed = docs.withColumn("symbol", F.concat_ws("|", "symbol", "doc"))
    flat = readers.flatten_facts(keyed)
    return rounded(flat.withColumn("symbol", F.split("symbol", r"\|")[0]), 2)


@query(
    "normalize_bars",
    f"""
SELECT symbol, dt, {r('open high low close adj_close')}, volume FROM (
 SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS dt, l_extendedprice/l_quantity AS open,
   l_extendedprice/l_quantity AS high, l_extendedprice/l_quantity AS low, l_extendedprice/l_quantity AS close,
   l_extendedprice/l_quantity*(1-l_discount) AS adj_close,
   CASE WHEN l_linenumber=1 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS volume,
   row_number() OVER (PARTITION BY p_brand, CAST(l_shipdate AS DATE)
     ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
 FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_linenumber <> 7) WHERE rn=1""",
)
def normalize_bars(d):
    part = d.table("part").select("p_partkey", F.col("p_brand").alias("symbol"))
    raw = (
        panels.priced_lines(d.spark, d.dir)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "symbol", "dt", "ord",
            # a planted bad price on every seventh line of an order
            F.when(F.col("ord.l_linenumber") == 7, -1.0).otherwise(F.col("price")).alias("open"),
            F.col("price").alias("high"), F.col("price").alias("low"), F.col("price").alias("close"),
            F.col("adj").alias("adj_close"),
            F.when(F.col("ord.l_linenumber") != 1, F.col("qty")).alias("volume"),
        )
    )
    return rounded(quality.normalize_bars(raw, "ord"))


def _spoiled(d):
    """Bars with planted ordering errors and empty sessions."""
    k = F.dayofmonth("dt")
    return d.bars.withColumn("high", F.when(k == 13, F.col("low") - 1).otherwise(F.col("high"))).withColumn(
        "volume", F.when(k == 21, 0).otherwise(F.col("volume")).cast("bigint")
    )


CTES["x_spoiled"] = """
SELECT symbol, dt, open, CASE WHEN day(dt)=13 THEN low-1 ELSE high END AS high, low, close, adj_close,
  CASE WHEN day(dt)=21 THEN 0 ELSE volume END AS volume FROM x_bars"""
CTES["x_issues"] = """
SELECT symbol, dt, 'error' AS severity, 'ohlc_ordering' AS issue, high-low AS detail FROM x_spoiled
WHERE high<low OR high<open OR high<close OR low>open OR low>close
UNION ALL SELECT symbol, dt, 'warn', 'zero_volume', 0 FROM x_spoiled WHERE volume=0
UNION ALL SELECT symbol, dt, 'warn', 'extreme_move', m FROM (SELECT symbol, dt,
   adj_close/lag(adj_close) OVER (PARTITION BY symbol ORDER BY dt)-1.0 AS m FROM x_spoiled) WHERE abs(m)>0.35
UNION ALL SELECT symbol, dt, 'warn', 'calendar_gap', g FROM (SELECT symbol, dt,
   dt - lag(dt) OVER (PARTITION BY symbol ORDER BY dt) AS g FROM x_spoiled) WHERE g>10"""
ISSUE = "SELECT symbol, dt, severity, issue, round(detail,6)+0.0 AS detail FROM x_issues WHERE issue='{}'"


@query("dq_ohlc_ordering", ISSUE.format("ohlc_ordering"))
def dq_ohlc_ordering(d):
    return rounded(quality.dq_ohlc_ordering(_spoiled(d)))


@query("dq_zero_volume", ISSUE.format("zero_volume"))
def dq_zero_volume(d):
    return rounded(quality.dq_zero_volume(_spoiled(d)))


@query("dq_extreme_move", ISSUE.format("extreme_move"))
def dq_extreme_move(d):
    return rounded(quality.dq_extreme_move(_spoiled(d)))


@query(
    "dq_calendar_gap",
    """
SELECT symbol, dt, 'warn' AS severity, 'calendar_gap' AS issue, CAST(g AS DOUBLE) AS detail FROM (
  SELECT symbol, dt, dt - lag(dt) OVER (PARTITION BY symbol ORDER BY dt) AS g
  FROM (SELECT DISTINCT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS dt FROM lineitem)) WHERE g>10""",
)
def dq_calendar_gap(d):
    days = panels.priced_lines(d.spark, d.dir).select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), "dt"
    ).distinct()
    return quality.dq_calendar_gap(days)


@query("dq_summary", "SELECT severity, issue, count(*) AS rows FROM x_issues GROUP BY ALL")
def dq_summary(d):
    return quality.dq_summary(quality.dq_issues(_spoiled(d)))


@query(
    "quarantine",
    f"SELECT symbol, dt, {r(PX)}, volume FROM x_spoiled s WHERE NOT EXISTS (SELECT 1 FROM x_issues i "
    "WHERE i.severity='error' AND i.symbol=s.symbol AND i.dt=s.dt)",
)
def quarantine(d):
    b = _spoiled(d)
    return rounded(quality.quarantine(b, quality.dq_issues(b)))


CTES["x_loads"] = """
SELECT b.symbol, b.dt, b.close, 1 AS run_id FROM x_bars b WHERE day(b.dt) <= 20
UNION ALL SELECT b.symbol, b.dt, b.close+1, 2 FROM x_bars b WHERE day(b.dt) >= 15"""


def _loads(d):
    b = d.bars.select("symbol", "dt", "close")
    old = b.filter(F.dayofmonth("dt") <= 20).withColumn("run_id", F.lit(1))
    new = b.filter(F.dayofmonth("dt") >= 15).withColumn("close", F.col("close") + 1).withColumn(
        "run_id", F.lit(2)
    )
    return old, new


@query(
    "upsert_latest",
    "SELECT symbol, dt, round(arg_max(close,run_id),6)+0.0 AS close, max(run_id) AS run_id FROM x_loads GROUP BY symbol, dt",
)
def upsert_latest(d):
    old, new = _loads(d)
    once = quality.upsert_latest(old, new, ["symbol", "dt"], "run_id")
    return rounded(once)


@query(
    "insert_ignore",
    "SELECT symbol, dt, round(arg_min(close,run_id),6)+0.0 AS close, min(run_id) AS run_id FROM x_loads GROUP BY symbol, dt",
)
def insert_ignore(d):
    old, new = _loads(d)
    return rounded(quality.insert_ignore(old, new, ["symbol", "dt"], "run_id"))


@query(
    "run_accounting",
    """
SELECT year(s.dt) AS run_id, count(DISTINCT s.symbol) AS symbols_loaded, count(s.dt) AS rows_loaded,
  CAST(sum(CASE WHEN i.dt IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS hard_errors,
  CASE WHEN count(s.dt)=0 THEN 'failed' WHEN sum(CASE WHEN i.dt IS NULL THEN 0 ELSE 1 END)>0 THEN 'partial' ELSE 'ok' END AS status
FROM x_spoiled s LEFT JOIN (SELECT symbol, dt FROM x_issues WHERE severity='error') i ON i.symbol=s.symbol AND i.dt=s.dt
GROUP BY year(s.dt)""",
)
def run_accounting(d):
    b = _spoiled(d)
    bad = quality.dq_ohlc_ordering(b).select("symbol", "dt", F.lit(1).alias("hard_error"))
    loads = b.join(bad, ["symbol", "dt"], "left").select(
        F.year("dt").cast("bigint").alias("run_id"), "symbol", "dt", F.coalesce("hard_error", F.lit(0)).alias("hard_error")
    )
    return quality.run_accounting(loads)


@query(
    "completeness_guard",
    """
SELECT strftime(action_date,'%Y-%m') AS month, count(*) AS rows, round(min(amount_usd),2)+0.0 AS smallest,
  CASE WHEN min(amount_usd) < 2e7 THEN 1 ELSE 0 END AS complete FROM x_contracts GROUP BY 1""",
)
def completeness_guard(d):
    return rounded(quality.completeness_guard(panels.contracts(d.spark, d.dir), 2e7), 2)


@query(
    "dedupe_actions",
    "SELECT award_id, action_date, round(amount_usd,2)+0.0 AS amount_usd, recipient, mod, agency, is_base, implausible FROM x_actions",
)
def dedupe_actions(d):
    raw = panels.contracts(d.spark, d.dir)
    again = raw.filter(F.dayofmonth("action_date") > 20)  # the same pages pulled twice
    return rounded(quality.dedupe_actions(raw.unionByName(again)), 2)


@query(
    "staleness_guard",
    """
SELECT a.n AS in_source, a.m AS source_last, b.n AS in_derived, b.m AS derived_last,
  CASE WHEN a.n <> b.n OR a.m > b.m THEN 1 ELSE 0 END AS stale
FROM (SELECT count(DISTINCT symbol) AS n, max(dt) AS m FROM x_bars) a,
     (SELECT count(DISTINCT symbol) AS n, max(dt) AS m FROM x_labels WHERE fwd_ret_5d IS NOT NULL) b""",
)
def staleness_guard(d):
    return quality.staleness_guard(d.bars, d.labels.filter("fwd_ret_5d is not null"))


@query("coverage", "SELECT symbol, count(*) AS bars, min(dt) AS first_dt, max(dt) AS last_dt FROM x_bars GROUP BY symbol")
def coverage(d):
    return quality.coverage(d.bars)


COVERED = ["mom_126d", "vol_20_annual", "atr_14", "sma_200"]


@query(
    "panel_coverage",
    " UNION ALL ".join(
        f"SELECT '{c}' AS signal, round(count({c})/count(*),6)+0.0 AS coverage FROM x_feat" for c in COVERED
    ),
)
def panel_coverage(d):
    return rounded(quality.panel_coverage(d.features, COVERED))


@query("drop_blank_rows", "SELECT obs_id, field, text_value, source FROM x_obs "
       "WHERE coalesce(trim(field),'')<>'' OR coalesce(trim(text_value),'')<>'' OR coalesce(trim(source),'')<>''")
def drop_blank_rows(d):
    o = panels.observations(d.spark, d.dir).select("obs_id", "field", "text_value", "source")
    return quality.drop_blank_rows(o, ["field", "text_value", "source"])


TRADE_RULES = {
    "trade_id": {"repeated": "first_row < row_id"},
    "symbol": {"not_listed": "symbol NOT IN (SELECT symbol FROM x_symbols)"},
    "direction": {"no_side": "direction NOT IN ('long','short')"},
    "opened_at": {"after_today": "opened_at > DATE '2001-06-01'"},
    "stop": {
        "wrong_side": "direction='long' AND stop>=entry OR direction='short' AND stop<=entry",
        "wide_stop": "direction IN ('long','short') AND abs(entry-stop)/entry > 0.25",
    },
    "target": {"wrong_side": "direction='long' AND target<=entry OR direction='short' AND target>=entry"},
    "shares": {"empty": "shares IS NULL", "not_above_zero": "shares <= 0", "oversized": "shares > 0 AND entry*shares > 40000"},
    "closed_at": {"before_open": "closed_at < opened_at"},
    "closed_at/exit": {"half_closed": "(closed_at IS NULL) <> (exit IS NULL)"},
    "signal_score": {"off_scale": "signal_score NOT BETWEEN 1 AND 10"},
    "followed_plan": {"plan_unmarked": "followed_plan IS NULL", "not_a_flag": "followed_plan NOT IN (0,1)"},
}


def issues_sql(row: str, source: str, rules: dict[str, dict[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT {row}, '{column}' AS \"column\", '{'warn' if code in ('wide_stop', 'oversized', 'plan_unmarked') else 'error'}' AS severity, '{code}' AS message FROM {source} WHERE {cond}"
        for column, codes in rules.items()
        for code, cond in codes.items()
    )


CTES["x_jt"] = "SELECT *, min(row_id) OVER (PARTITION BY trade_id) AS first_row FROM x_journal"


@query("validate_trades", issues_sql("row_id", "x_jt", TRADE_RULES))
def validate_trades(d):
    return quality.validate_trades(
        panels.journal(d.spark, d.dir), d.symbols, F.lit("2001-06-01").cast("date")
    )


OBS_RULES = {
    "symbol": {"not_listed": "symbol NOT IN (SELECT symbol FROM x_up)"},
    "dt": {"no_date": "dt IS NULL"},
    "field": {"empty": "trim(field) = ''"},
    "value": {"nothing_observed": "value IS NULL AND text_value IS NULL"},
    "source": {"empty": "trim(source) = ''"},
    "symbol/dt/field": {"repeated": "first_row < obs_id"},
}
CTES["x_up"] = "SELECT upper(symbol) AS symbol FROM x_symbols"
CTES["x_ot"] = (
    "SELECT obs_id, upper(symbol) AS symbol, dt, field, value, text_value, source, "
    "min(obs_id) OVER (PARTITION BY upper(symbol), dt, trim(field)) AS first_row FROM x_obs"
)


@query("validate_observations", issues_sql("obs_id", "x_ot", OBS_RULES))
def validate_observations(d):
    return quality.validate_observations(panels.observations(d.spark, d.dir), d.symbols)


@query(
    "snapshot_diff",
    """
SELECT symbol, 'added' AS change FROM (SELECT symbol FROM x_snap WHERE snapshot='now' EXCEPT SELECT symbol FROM x_snap WHERE snapshot='before')
UNION ALL
SELECT symbol, 'removed' FROM (SELECT symbol FROM x_snap WHERE snapshot='before' EXCEPT SELECT symbol FROM x_snap WHERE snapshot='now')""",
)
def snapshot_diff(d):
    return quality.snapshot_diff(panels.snapshots(d.bars))


@query(
    "latest_row",
    "SELECT symbol, max(dt) AS dt, round(arg_max(close, dt),6)+0.0 AS close FROM x_bars GROUP BY symbol",
)
def latest_row(d):
    return rounded(quality.latest_row(d.bars))


# ------------------------------------------------- calendar, filters, entities
@query("trading_calendar", "SELECT * FROM x_cal")
def trading_calendar(d):
    return d.calendar


@query("bars_indexed", f"SELECT symbol, dt, day_index, sector, kind, {r(PX)}, volume FROM x_ix")
def bars_indexed(d):
    return rounded(d.ix)


@query(
    "cap_bucket",
    """SELECT symbol, inclusion_reason, CASE WHEN contains(inclusion_reason,'smallcap600') THEN 'small'
  WHEN contains(inclusion_reason,'midcap400') THEN 'mid' WHEN contains(inclusion_reason,'S&P 500') THEN 'large'
  ELSE 'other' END AS bucket FROM x_wsymbols""",
)
def cap_bucket(d):
    return d.wsymbols.select("symbol", "inclusion_reason", entities.cap_bucket().alias("bucket"))


CTES["x_entities"] = """
SELECT a.*, CASE WHEN contains(recipient,'FURNITURE') THEN NULL
    WHEN contains(recipient,'AUTOMOBILE') THEN 'Brand#1'
    WHEN contains(recipient,'BUILDING') AND action_date <= DATE '1998-12-31' THEN 'Brand#2'
    WHEN contains(recipient,'BUILDING') THEN 'Brand#3'
    WHEN contains(recipient,'MACHINERY') AND action_date >= DATE '1997-01-01' THEN 'Brand#4' END AS ticker,
  CASE WHEN contains(recipient,'FURNITURE') THEN 'private'
    WHEN contains(recipient,'AUTOMOBILE') OR contains(recipient,'BUILDING') THEN 'mapped'
    WHEN contains(recipient,'MACHINERY') THEN CASE WHEN action_date >= DATE '1997-01-01' THEN 'mapped' ELSE 'Brand#4 outside its window' END
    ELSE 'unmatched' END AS why
FROM x_actions a"""


def _resolved(d):
    return entities.resolve(d.actions, panels_rules())


def panels_rules():
    return entities.Rules(
        names=(
            ("AUTOMOBILE", "Brand#1", "1990-01-01", "2099-12-31"),
            ("BUILDING", "Brand#2", "1990-01-01", "1998-12-31"),
            ("BUILDING", "Brand#3", "1999-01-01", "2099-12-31"),
            ("MACHINERY", "Brand#4", "1997-01-01", "2099-12-31"),
        ),
        unpriceable=(("FURNITURE", "private"),),
    )


@query(
    "resolve_entity",
    "SELECT award_id, action_date, round(amount_usd,2)+0.0 AS amount_usd, recipient, mod, ticker, why FROM x_entities",
)
def resolve_entity(d):
    return rounded(
        _resolved(d).select("award_id", "action_date", "amount_usd", "recipient", "mod", "ticker", "why"), 2
    )


@query(
    "entity_coverage",
    """
SELECT why, count(*) AS actions, round(sum(amount_usd),0)+0.0 AS usd,
  round(sum(amount_usd)/(SELECT sum(amount_usd) FROM x_entities),6)+0.0 AS usd_share,
  round(count(*)/(SELECT count(*) FROM x_entities),6)+0.0 AS row_share, max(CASE WHEN ticker IS NULL THEN 0 ELSE 1 END) AS priceable
FROM x_entities GROUP BY why""",
)
def entity_coverage(d):
    return rounded(entities.coverage(_resolved(d)), usd=0)


@query(
    "entity_unmatched",
    """SELECT recipient, count(*) AS actions, round(sum(amount_usd),0)+0.0 AS usd FROM x_entities WHERE why='unmatched'
GROUP BY recipient ORDER BY sum(amount_usd) DESC, recipient LIMIT 15""",
)
def entity_unmatched(d):
    return rounded(entities.largest_unmatched(_resolved(d)), 0)
