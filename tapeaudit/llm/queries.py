"""The operators' registered queries and, where SQL can express them, their oracles."""

from __future__ import annotations

import os
from collections.abc import Callable
from hashlib import sha256

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe_codec, decontaminate, exact_dedup, language_id, line_dedup, lm_score, minhash, periodic_runs, sharding, substring_dedup,
    token_counts, vector_codes, warc,
)
from .common import table

#: Vocabulary files; another folder can be named in TAPEAUDIT_VOCABULARIES.
VOCABULARIES = os.environ.get("TAPEAUDIT_VOCABULARIES")
SHARDS = 24


def vocabulary_path(name: str) -> str:
    return f"{VOCABULARIES}/{name}" if VOCABULARIES else public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), keep_ids=False)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_id", "row_fp")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents")).drop("row_id", "row_fp")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url", "payload").select(
        "page_id", F.col("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


def planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by crc32 of its id repeats its words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = docs.filter((h % 10 == 0) & (F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))).select("doc_id", words.alias("w"), F.floor(h / 10).alias("g"))
    some = some.withColumn("a", F.pmod("g", F.size("w")).cast("int"))
    some = some.withColumn("p", (1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    source = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    changed = some.select("doc_id", F.array_join(F.transform(source, lambda i: F.get("w", i)), " ").alias("text"))
    rest = docs.filter(~F.coalesce((h % 10 == 0) & F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))).select("doc_id", "text")
    return rest.unionByName(changed)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted_repeats(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("small"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    said = F.when(F.size("runs") == 0, "").otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.small")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.small")).cast("bigint").alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    said = ",".join(map(str, books.ravel().tolist()))
    return coded.withColumn("codebooks_sha256", F.lit(sha256(said.encode()).hexdigest()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_language_id, op3_lm_scoring, op4_exact_dedup, op5_bpe, op6_decontaminate, op7_minhash,
        op8_token_counts, op9_sharding, op10_warc, op11_periodic_runs, op12_substring_dedup, op13_vector_codes,
    )
}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = r"""
WITH lines AS (
  SELECT doc_id, pos - 1 AS pos, ls[pos] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS u(pos)
), runs AS (
  SELECT doc_id, pos, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c
  FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM runs
  WHERE c IS NOT NULL AND NOT regexp_full_match(a || b || c, '\s*')
), gone AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM later, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1
), left_over AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, o.text
FROM documents d LEFT JOIN left_over o ON d.doc_id = o.doc_id"""

_OP4 = f"""
WITH t AS (SELECT doc_id, {_LOWER.format("text")} AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM t"""

_OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, s, s + least(len(w), 13) - 1) AS words
  FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(s) WHERE len(w) > 0
), runs AS (
  SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS words
  FROM d, (SELECT DISTINCT n FROM win) AS sizes, unnest(range(1, len(w) - n + 2)) AS u(s)
), hits AS (SELECT DISTINCT doc_id, s, runs.n AS n, item_id FROM runs JOIN win ON runs.n = win.n AND runs.words = win.words),
hit AS (SELECT doc_id, count(DISTINCT s + k) AS n_hit FROM hits, unnest(range(0, n)) AS u(k) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN named ON d.doc_id = named.doc_id"""

_OP9 = f"""
WITH RECURSIVE digests AS (SELECT DISTINCT doc_id, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
jumps AS (
  SELECT doc_id, CAST(('0x' || substr(h, 1, 16)) AS UBIGINT)::HUGEINT AS k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM digests
  UNION ALL
  SELECT doc_id, k, j, CAST(floor(CAST(j + 1 AS DOUBLE) * (2147483648.0::DOUBLE / CAST(k // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k, b, j FROM jumps WHERE j < {SHARDS + 1})
), shards AS (
  SELECT doc_id, max(b) FILTER (b < {SHARDS}) AS shard, max(b) FILTER (b < {SHARDS + 1}) AS grown FROM jumps GROUP BY doc_id
), crc_table AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) AS r(n))
), sums AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST(('0x' || x) AS BIGINT))),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM documents, crc_table
)
SELECT s.doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY CAST(('0x' || substr(h, 17, 3)) AS BIGINT), s.doc_id, size, crc) - 1 AS BIGINT) AS slot,
       CAST(grown AS INTEGER) AS grown_shard
FROM sums s JOIN shards USING (doc_id) JOIN digests USING (doc_id)"""

_OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""

_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP11 = rf"""
WITH crc_table AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) AS r(n))
), sums AS (
  SELECT doc_id, {_SPLIT} AS w,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), ''))), '..'), lambda x: CAST(('0x' || x) AS BIGINT))),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM documents, crc_table
), params AS (
  SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS e FROM sums
), d AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + e)) END + 1]) END AS w
  FROM params
), lags AS (
  SELECT doc_id, n, w, q FROM d, unnest(range(1, n // 4 + 1)) AS u(q) WHERE n >= 6
), same AS (
  SELECT doc_id, q, i FROM lags, unnest(range(1, n - q + 1)) AS u(i) WHERE w[i] = w[i + q]
), stretches AS (
  SELECT doc_id, q, min(i) - 1 AS start, count(*) + q AS length
  FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
), best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS k FROM runs),
said AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, i FROM runs, unnest(range(start + period, start + length)) AS u(i)),
kept AS (
  SELECT d.doc_id, string_agg(CASE WHEN gone.i IS NULL THEN w[d.i + 1] END, ' ' ORDER BY d.i) AS text
  FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM d) AS d LEFT JOIN gone ON d.doc_id = gone.doc_id AND d.i = gone.i GROUP BY d.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(said.text, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN said ON d.doc_id = said.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN best ON d.doc_id = best.doc_id AND best.k = 1"""

_OP12 = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
win AS (SELECT doc_id, s, list_slice(w, s, s + 19) AS words FROM d, unnest(range(1, len(w) - 18)) AS u(s)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY words ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM later, unnest(range(20)) AS u(k)),
left_over AS (
  SELECT d.doc_id, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN w[d.i] END, ' ' ORDER BY d.i) AS text
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) AS d LEFT JOIN gone ON d.doc_id = gone.doc_id AND d.i = gone.i GROUP BY d.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN left_over ON d.doc_id = left_over.doc_id"""


def _op13() -> str:
    """Codebook tables b0, b1, b2 and assignments c0, c1, c2, one after the other."""
    steps = [r"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS x FROM kept, unnest(range(16)) AS u(p)
), b0 AS MATERIALIZED (
  SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 64
)"""]
    for k in range(3):
        steps.append(f"""c{k} AS MATERIALIZED (
  SELECT vec_id, label, p, x, best.e AS e, best.d AS d FROM (
    SELECT vec_id, any_value(parts.label) AS label, parts.p AS p, any_value(parts.x) AS x,
           min(struct_pack(d := list_sum(list_transform(list_zip(parts.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := b.e)) AS best
    FROM parts JOIN b{k} AS b ON parts.p = b.p GROUP BY vec_id, parts.p)
)""")
        if k < 2:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.p AS p, b.e AS e, coalesce(m.x, b.x) AS x FROM b{k} AS b LEFT JOIN (
    SELECT p, e, list(x ORDER BY i) AS x FROM (
      SELECT p, e, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM c{k}, unnest(range(1, len(c{k}.x) + 1)) AS u(i) GROUP BY p, e, i)
    GROUP BY p, e) AS m ON b.p = m.p AND b.e = m.e
)""")
    steps.append("""books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b2),
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, sum(d) AS error FROM c2 GROUP BY vec_id
)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, books""")
    return ", ".join(steps)


ORACLES: dict[str, str] = {
    "op1_line_dedup": _OP1, "op4_exact_dedup": _OP4, "op6_decontaminate": _OP6, "op9_sharding": _OP9, "op10_warc": _OP10,
    "op11_periodic_runs": _OP11, "op12_substring_dedup": _OP12, "op13_vector_codes": _op13(),
}
