"""Token counts with a whole-token shortcut: strings proved to encode alone as one token are counted directly."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .bpe_codec import CHUNK, segments, vocabulary

# The split pattern of the vocabulary's library, a fixed value, and what it is on lower-cased ASCII text alone.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""")
ASCII_PATTERN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+""", re.ASCII)

# Capitals of a newer Unicode than Python's, with their small letters, fixed values.
NEWER_CAPITALS = {0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B, 0x1C89: 0x1C8A}
NEWER_CAPITALS |= {c: c + 32 for c in range(0x10D50, 0x10D66)}
#: A capital sigma is small the same way everywhere; lower() alone would change it at a word's end.
CAPITALS = NEWER_CAPITALS | {ord("Σ"): ord("σ")}

_known: dict[str, tuple[dict[str, int], bpe.Memory]] = {}  # per worker process: counts of words, by vocabulary


def whole_words(v: bpe.Vocabulary) -> dict[str, int]:
    """The pre-tokens that are one token: vocabulary strings with the word-end mark that merge into themselves."""
    mark = len(v.suffix)
    ends = (t[:-mark] if mark else t for t, one in zip(v.texts, v.whole) if one and t.endswith(v.suffix) and len(t) > mark)
    out = {}
    for raw in ends:
        try:
            out[raw.decode()] = 1
        except UnicodeDecodeError:  # part of a character is no pre-token
            continue
    return out


def pre_tokens(text: str) -> list[str]:
    """Composed, lower-cased character by character, split; white space is dropped."""
    if text.isascii():
        return ASCII_PATTERN.findall(text.lower())
    return PATTERN.findall(unicodedata.normalize("NFC", text).translate(CAPITALS).lower())


class Counter:
    def __init__(self, v: bpe.Vocabulary, whole: dict[str, int], known: bpe.Memory):
        self.v, self.whole, self.known = v, whole, known

    def count(self, texts: list[str]) -> list[int]:
        special = self.v.specials
        pieces = [[p if p in special else pre_tokens(p) for p in segments(t, special)] for t in texts]
        found = {w for ps in pieces for p in ps if isinstance(p, list) for w in p}
        new = [w for w in found if w not in self.whole and w not in self.known]
        self.known.room_for(len(new))
        if len(self.known) == 0:
            self.known.update(self.whole)
            new = [w for w in found if w not in self.whole]
        parts = [bpe.split(self.v, w.encode() + self.v.suffix) for w in new]
        short = [i for i, p in enumerate(parts) if len(p) <= bpe.LONG_WORD]
        for i, symbols in zip(short, bpe.merge_many(self.v, [parts[i] for i in short])):
            self.known[new[i]] = len(symbols)
        for i, p in enumerate(parts):
            if len(p) > bpe.LONG_WORD:
                self.known[new[i]] = len(bpe.merge(self.v, p))
        look = self.known.__getitem__
        return [sum(1 if isinstance(p, str) else sum(map(look, p)) for p in ps) for ps in pieces]


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    Counts equal the lengths that the vocabulary's own library gives without added special tokens; a special
    string inside a text is one token. Which vocabulary strings encode alone as one token is proved once, when the
    vocabulary is read on the driver; pre-tokens that are such a string count one, the others are merged. The
    tables are broadcast (a few MB, the file's size); there is no shuffle.

    A null text is empty: 0 bytes and 0 tokens. Rows that repeat an id are rows of their own. No rows in,
    no rows out. Other columns are not read.
    """
    v = vocabulary(vocabulary_path)
    if not v.suffix:
        raise ValueError("the shortcut here is for vocabularies with an end-of-word mark")
    shared = docs.sparkSession.sparkContext.broadcast((v, whole_words(v)))
    kind = docs.schema[id_col].dataType

    def run(parts: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        table, whole = shared.value
        if vocabulary_path not in _known:
            _known[vocabulary_path] = whole, bpe.Memory(bpe.MEMORY + len(whole))
        counter = Counter(table, *_known[vocabulary_path])
        for part in parts:
            at = 0
            for group in bpe.batches((t.as_py() or "" for t in part.column(1)), CHUNK):
                counts = pa.array(counter.count(group), pa.int64())
                sizes = pa.array([len(t.encode()) for t in group], pa.int64())
                over = pa.array([c.as_py() > limit for c in counts], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(group)), sizes, counts, over], names)
                at += len(group)

    names = [id_col, "n_bytes", "n_tokens", "over_limit"]
    schema = f"`{id_col}` {kind.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
