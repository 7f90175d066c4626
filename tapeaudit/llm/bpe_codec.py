"""BPE encoding and decoding of whole texts: greedy proposals, vectorised pair checks, exact merging of the rest."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

#: Characters of text that a task works on at once (a longer text is worked on alone).
CHUNK = 1_000_000
# The split pattern of the vocabulary's library, a fixed value, and what it is on ASCII text alone.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
ASCII_PATTERN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+""", re.ASCII)

# The same on text below U+0250: letters, digits and white space of that range, fixed values.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
LATIN_PATTERN = re.compile(rf"""'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+""")
BEYOND_LATIN = re.compile("[^\u0000-\u024f]")

vocabulary = lru_cache(maxsize=4)(bpe.load)
_known: dict[str, bpe.Memory] = {}  # per worker process: words already encoded, by vocabulary


def segments(text: str, specials: dict[str, int]) -> list[str]:
    """The text cut at special strings, which stay as pieces of their own."""
    if not any(s in text for s in specials):
        return [text]
    longest_first = sorted(specials, key=len, reverse=True)
    return [p for p in re.split("(" + "|".join(map(re.escape, longest_first)) + ")", text) if p]


def pre_tokens(text: str) -> list[str]:
    if text.isascii():
        return ASCII_PATTERN.findall(text)
    return (PATTERN if BEYOND_LATIN.search(text) else LATIN_PATTERN).findall(text)


class Codec:
    """Encoder and decoder of one vocabulary, with the words it has met."""

    def __init__(self, v: bpe.Vocabulary, known: bpe.Memory):
        self.v, self.known = v, known
        self.bytes_of: dict[int, bytes] = {int(i): t for i, t in zip(v.ids, v.texts)}
        self.bytes_of |= {i: s.encode() for s, i in v.specials.items()}
        self.id_of: list[int] = v.ids.tolist()
        self.said_as = [str(i) for i in self.id_of]
        self.merged_exactly = 0

    def learn(self, found: set[str]) -> None:
        """Encode the words that are not in memory yet."""
        new = [w for w in found if w not in self.known]
        self.known.room_for(len(new))
        if not self.known:
            new = list(found)
        symbols, failed = bpe.encode_words(self.v, [w.encode() for w in new])
        self.merged_exactly += failed
        ids, said = self.id_of.__getitem__, self.said_as.__getitem__
        for w, s in zip(new, symbols):
            self.known[w] = tuple(map(ids, s)), ",".join(map(said, s))

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """Ids of each text, and the same in decimal joined by commas."""
        special = self.v.specials
        pieces = [[p if p in special else pre_tokens(p) for p in segments(t, special)] for t in texts]
        found: set[str] = set()
        for ps in pieces:
            for p in ps:
                if isinstance(p, list):
                    found.update(p)
        self.learn(found)
        look, out = self.known.__getitem__, []
        for ps in pieces:
            said = chain.from_iterable([((special[p],), str(special[p]))] if isinstance(p, str) else map(look, p) for p in ps)
            ids, texts_of_ids = zip(*said) if any(ps) else ((), ())
            out.append((list(chain.from_iterable(ids)), ",".join(texts_of_ids)))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _codec(v: bpe.Vocabulary, name: str) -> Codec:
    return Codec(v, _known.setdefault(name, bpe.Memory()))


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Token ids of every whole text and the text decoded from them.

    Returns id, n_tokens, ids_sha256 (of the ids in decimal, joined by commas), decoded_sha256 and, with
    keep_ids, ids and decoded. Ids equal those of the vocabulary's own library without added special tokens; special
    strings inside a text are their special ids.

    The vocabulary is read on the driver and broadcast (its size is the file's, a few MB). Tasks need no other
    data: no shuffle, and a lost task is computed again. A worker keeps up to bpe.MEMORY encoded words.

    A null text is empty: no ids, and the digests of the empty string. Rows that repeat an id are rows of
    their own. No rows in, no rows out. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))
    kind = docs.schema[id_col].dataType

    def run(parts: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        codec = _codec(shared.value, vocabulary_path)
        for part in parts:
            at = 0
            for group in bpe.batches((t.as_py() or "" for t in part.column(1)), CHUNK):
                encoded = codec.encode(group)
                ids = [x for x, _ in encoded]
                back = [codec.decode(x) for x in ids]
                columns = [
                    part.column(0).slice(at, len(group)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([sha256(x.encode()).hexdigest() for _, x in encoded], pa.string()),
                    pa.array([sha256(t.encode()).hexdigest() for t in back], pa.string()),
                ]
                if keep_ids:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())]
                at += len(group)
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    schema = f"`{id_col}` {kind.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" * keep_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
