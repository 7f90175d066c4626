"""Language identification: TF-IDF character n-grams, FTRL-trained multinomial logistic regression, temperature."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import hinted, unused

UNKNOWN = "und"
#: Slots of hashed n-grams (of 1 to ORDER letters or word edges).
SLOTS = 1 << 16
ORDER = 3
#: Labelled rows that the classifier is fitted on, at most; languages share them about equally.
SAMPLE = 2_000
#: Every so many-th of these rows sets the temperature instead.
CALIBRATION = 5
EPOCHS = 3
#: Values are shares of a document, so steps are long.
ALPHA, BETA, L1, L2 = 20.0, 1.0, 1e-3, 1e-4
#: Characters of text that a task works on at once.
CHUNK = 250_000
_HELD_OUT = 2


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its small letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngram_slots(text: str) -> np.ndarray:
    """Slots of the text's n-grams, repeated as often as they occur; runs of other characters are one word edge."""
    code = _letters()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    code = code[np.r_[True, (code[1:] != 0) | (code[:-1] != 0)]]
    if len(code) < 3 and not code.any():
        return np.zeros(0, np.uint32)
    out, h = [], np.zeros(len(code), np.uint32)
    for n in range(1, ORDER + 1):
        h = (h[: len(code) - n + 1] * np.uint32(0x01000193)) ^ (code[n - 1 :] * np.uint32(0x9E3779B1))
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F)
        slot = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - SLOTS.bit_length() + 1)
        out.append(slot[code != 0] if n == 1 else slot)
        if len(code) <= n:
            break
    return np.concatenate(out)


@dataclass
class Model:
    """languages; weights (slots x languages, IDF already in them); bias; temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, slots: list[np.ndarray]) -> np.ndarray:
        """One row per document. Term frequencies are shares of the document's n-grams, so a document's score is the
        mean of its n-grams' weights."""
        sizes = np.array([len(s) for s in slots])
        out = np.tile(self.bias, (len(slots), 1)).astype(np.float64)
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.cumsum(sizes[full]) - sizes[full]
            rows = self.weights[np.concatenate([slots[i] for i in full])]
            out[full] += np.add.reduceat(rows, starts, axis=0, dtype=np.float64) / sizes[full, None]
        return out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], slots: int, classes: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader (proximal, per-coordinate rates, elastic net) over rows of (slot, value, class)
    in the given order; returns weights and bias."""
    z, n = np.zeros((slots + 1, classes)), np.zeros((slots + 1, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(ns)) / ALPHA + L2)

    for i in order:
        at, value, label = rows[i]
        w = weights(z[at], n[at])
        p = _softmax(value @ w)
        p[label] -= 1
        g = value[:, None] * p
        grown = n[at] + g * g
        z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
        n[at] = grown
    w = weights(z, n)
    return w[:slots], w[slots]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss between 0.1 and 10 (golden-section search on its logarithm)."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, part = np.log(0.1), np.log(10.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == _HELD_OUT


def _document_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each slot occurs, and how many there are. Tasks count on their own; what reaches the
    driver is one row per slot."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        counts = np.zeros(SLOTS + 1, np.int64)
        for part in parts:
            for text in part.column(0):
                seen = np.zeros(SLOTS + 1, bool)
                seen[ngram_slots(text.as_py() or "")] = True
                seen[SLOTS] = True
                counts += seen
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["slot", "n"])

    rows = texts.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS + 1, np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out[:SLOTS], int(out[SLOTS])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model of the languages in `docs`; None where no row has a language, a letter and is not held out.

    Document frequencies cover every row that may be learned from. The classifier sees at most `sample` of them: the
    rows with the smallest hash times the number of rows of their language, so each language has about the same
    share. One task fits it (its input is bounded by `sample` rows of at most SLOTS values each).
    """
    text, lang = F.col(text_col), F.col(lang_col)
    rows = docs.filter(~held_out(id_col) & lang.isNotNull() & text.rlike(r"\p{L}")).select(
        text.alias("text"), lang.cast("string").alias("lang"), F.xxhash64(F.col(id_col), text).alias("draw")
    )
    sizes = rows.groupBy("lang").count()
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not languages:
        return None
    frequency, total = _document_counts(rows.select("text"))
    idf = np.log((1 + total) / (1 + frequency)) + 1
    place = F.pmod(F.col("draw"), F.lit(1 << 40)) * F.col("count")
    chosen = rows.select("lang", "draw").join(sizes, "lang").orderBy(place, "draw").limit(sample).select("lang", "draw").distinct()
    # rows that repeat an id and a text, and copies without an id, share a draw: the fit sees their text once
    once = rows.join(hinted(chosen, sample), ["lang", "draw"]).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    picked = once.select("text", "lang", "draw").repartition(1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known, seen = {name: i for i, name in enumerate(languages)}, []
        for part in parts:
            for text, lang, draw in zip(part.column(0), part.column(1), part.column(2).to_pylist()):
                slots = ngram_slots(text.as_py())
                at, count = np.unique(slots, return_counts=True)
                value = (count / max(1, len(slots)) * idf[at]).astype(np.float32)
                seen.append((draw, known[lang.as_py()], np.append(at.astype(np.int32), SLOTS).astype(np.int32), np.append(value, np.float32(1)), len(slots)))
        seen.sort(key=lambda r: r[:2])
        fitted = [r for i, r in enumerate(seen) if i % CALIBRATION or len(seen) < 2 * CALIBRATION]
        rest = [r for i, r in enumerate(seen) if i % CALIBRATION == 0]
        order = np.concatenate([np.random.default_rng(e).permutation(len(fitted)) for e in range(EPOCHS)])
        w, bias = ftrl([(at, value, label) for _, label, at, value, _ in fitted], SLOTS, len(languages), order)
        logits = np.array([value[:-1] @ w[at[:-1]] + bias for _, _, at, value, _ in rest])
        t = temperature(logits, np.array([r[1] for r in rest])) if rest else 1.0
        used = np.flatnonzero(np.abs(w).sum(axis=1))
        at = np.r_[used, SLOTS, SLOTS + 1]
        table = np.vstack([w[used], bias, np.full(len(languages), t)])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table.tolist(), pa.list_(pa.float64()))], ["slot", "w"])

    out = picked.mapInArrow(run, "slot bigint, w array<double>").toArrow()
    table = np.zeros((SLOTS + 2, len(languages)))
    table[out["slot"].to_numpy()] = np.array(out["w"].to_pylist())
    weights = (table[:SLOTS] * idf[:, None]).astype(np.float32)
    return Model(languages, weights, table[SLOTS], float(table[SLOTS + 1][0]))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) of `docs` with lang_pred and score (the calibrated probability).

    The model is slots x languages and is broadcast. A null text, or one without a letter, is `und` with score 0,
    and so is every text without a model. There is no shuffle.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    (read,) = unused(docs, "__text")
    source = docs.select(F.col(text_col).cast("string").alias(read), *keep)
    schema = source.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        m = shared.value
        for part in parts:
            at = 0
            for group in bpe.batches((t.as_py() or "" for t in part.column(0)), CHUNK):
                slots = [ngram_slots(t) for t in group]
                names, scores = [UNKNOWN] * len(group), np.zeros(len(group))
                full = [i for i, s in enumerate(slots) if len(s)]
                if m is not None and full:
                    p = m.probabilities(m.logits([slots[i] for i in full]))
                    scores[full] = p.max(axis=1)
                    for i, best in zip(full, p.argmax(axis=1)):
                        names[i] = m.languages[best]
                rest = [part.column(1 + k).slice(at, len(group)) for k in range(len(keep))]
                at += len(group)
                yield pa.RecordBatch.from_arrays([*rest, pa.array(names), pa.array(scores)], [*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """id, held_out, lang_pred, score of every document, with a model learned from the rows that are not held out.

    Rows that repeat an id are held out together. A null id counts as the empty string. No rows in, no rows out.
    """
    model = fit(docs, id_col, text_col, lang_col, sample)
    return predict(docs.withColumn("held_out", held_out(id_col)), model, text_col, [id_col, "held_out"])
