"""A corpus pipeline: language, repeated lines, near-duplicates, benchmark passages, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeaudit.functions import cut
from tapeaudit.llm import bpe_codec, decontaminate, language_id, line_dedup, minhash
from tapeaudit.llm.common import hinted, row_key, table
from tapeaudit.llm.queries import vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language is less probable than this is rejected.
MIN_LANGUAGE_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter, and doubtful ones, go."""
    model, text = language_id.fit(docs), F.col("text")
    keys = row_key("doc_id", text)
    judged = language_id.predict(docs.select("text", *keys), model, keep=["__row_id", "__row_fp"])
    doubtful = (F.col("lang_pred") == language_id.UNKNOWN) | (F.col("score") < MIN_LANGUAGE_SCORE)
    gone = cut(judged.filter(doubtful).select("__row_id", "__row_fp").distinct())
    return docs.select(*COLUMNS, *keys).join(hinted(gone), ["__row_id", "__row_fp"], "left_anti").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of passages that occurred before; a document of which nothing is left goes."""
    out = line_dedup.line_dedup(docs.select(*COLUMNS)).filter("n_removed = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    gone = cut(judged.filter("contaminated").select(F.col("row_id").alias("__row_id"), F.col("row_fp").alias("__row_fp")).distinct())
    keys = row_key("doc_id", F.col("text"))
    return docs.select(*COLUMNS, *keys).join(hinted(gone), ["__row_id", "__row_fp"], "left_anti").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of each document that is left."""
    return bpe_codec.encode_decode(docs, vocabulary_path("byte_bpe_50k.json"), keep_ids=False)


STAGES = [
    ("language_id", known_language), ("line_dedup", without_repeated_lines), ("minhash_near_dedup", without_near_copies),
    ("decontaminate", without_benchmark), ("bpe", encoded),
]

#: Language, near-duplicates and tokens are beyond SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
