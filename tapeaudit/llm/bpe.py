"""Byte-pair vocabularies as tables, and exact encoding of words by speculation and verification."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np

#: Words whose encodings a worker keeps; the memory is emptied when it is full.
MEMORY = 200_000
#: A word longer than this many bytes is merged exactly and not kept.
LONG_WORD = 512
_NEVER = np.int64(1) << 40
#: Spreads the keys of pairs over their table (2^64 over the golden ratio, a fixed value).
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """What a tokenizer file says, in a form that travels to the executors (a few MB, the file's size).

    Symbols are numbered in the order in which merges make them: first those that no merge makes, then one
    per merge, so a number is also the merge's rank. `left` and `right` name the two parts of a merged
    symbol (itself where there is none); `pair_keys` and `pair_made` are the merges sorted by pair.
    """

    texts: list[bytes]
    ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray
    pair_made: np.ndarray
    suffix: bytes
    specials: dict[str, int]
    whole: np.ndarray
    _by_text: dict[bytes, int] = field(default_factory=dict, repr=False)
    _by_pair: dict[tuple[int, int], int] = field(default_factory=dict, repr=False)
    _proposals: dict[bytes, int] = field(default_factory=dict, repr=False)
    _longest: dict[bytes, int] = field(default_factory=dict, repr=False)
    _atoms: dict[int, int] = field(default_factory=dict, repr=False)
    _table: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {k: v if not k.startswith("_") else {} for k, v in self.__dict__.items()}

    @property
    def by_text(self) -> dict[bytes, int]:
        if not self._by_text:
            self._by_text = {t: n for n, t in enumerate(self.texts)}
        return self._by_text

    @property
    def by_pair(self) -> dict[tuple[int, int], int]:
        if not self._by_pair:
            made = range(len(self.texts))
            self._by_pair = {(int(self.left[n]), int(self.right[n])): n for n in made if self.left[n] != n}
        return self._by_pair

    @property
    def proposals(self) -> dict[bytes, int]:
        """The symbols that encode as themselves; no others may be proposed."""
        if not self._proposals:
            self._proposals = {t: n for n, t in enumerate(self.texts) if self.whole[n]}
        return self._proposals

    @property
    def longest(self) -> dict[bytes, int]:
        """The longest such symbol that starts with given four bytes (or has just these)."""
        if not self._longest:
            out: dict[bytes, int] = {}
            for t in self.proposals:
                out[t[:4]] = max(out.get(t[:4], 1), len(t))
            self._longest = out
        return self._longest

    @property
    def atoms(self) -> dict[int, int]:
        """The symbol of each byte value that has one."""
        if not self._atoms:
            self._atoms = {t[0]: n for t, n in self.by_text.items() if len(t) == 1}
        return self._atoms

    @property
    def table(self) -> dict[str, np.ndarray]:
        """The merges by pair in a table with open addressing, at most a quarter full: `keys` (-1 where free) and `made`."""
        if not self._table:
            size = 1 << (4 * len(self.pair_keys) + 4).bit_length()
            keys, made = np.full(size, -1, np.int64), np.full(size, _NEVER)
            for key, m, at in zip(self.pair_keys.tolist(), self.pair_made.tolist(), _places(self.pair_keys, size).tolist()):
                while keys[at] >= 0:
                    at = (at + 1) % size
                keys[at], made[at] = key, m
            self._table = {"keys": keys, "made": made}
        return self._table


def _places(keys: np.ndarray, size: int) -> np.ndarray:
    """Where the search for each key begins in a table of `size` (a power of two)."""
    return (keys.astype(np.uint64) * _SPREAD >> np.uint64(65 - size.bit_length())).astype(np.int64)


def load(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the `tokenizers` format."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    back = {c: bytes([b]) for b, c in enumerate(byte_symbols())}
    suffix = model.get("end_of_word_suffix") or ""
    end = b"\xff" + suffix.encode() if suffix else b""  # 0xff is in no UTF-8 text, so a mark can't be mistaken for letters

    def raw(symbol: str) -> bytes:
        body, mark = (symbol.removesuffix(suffix), end) if suffix and symbol.endswith(suffix) else (symbol, b"")
        return b"".join(back[c] for c in body) + mark

    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = {a + b: (a, b) for a, b in merges}
    if len(made) != len(merges):
        raise ValueError("two merges make the same symbol; the pair check needs one merge per symbol")
    atoms = [s for s in model["vocab"] if s not in made]
    names = atoms + list(made)
    number = {s: n for n, s in enumerate(names)}
    left = np.arange(len(names), dtype=np.int64)
    right = left.copy()
    for s, (a, b) in made.items():
        left[number[s]], right[number[s]] = number[a], number[b]
    merged = np.arange(len(atoms), len(names))
    keys = left[merged] << 32 | right[merged]
    order = np.argsort(keys)
    v = Vocabulary(
        texts=[raw(s) for s in names], ids=np.array([model["vocab"][s] for s in names], np.int64), left=left, right=right,
        pair_keys=keys[order], pair_made=merged[order], suffix=end, whole=np.ones(len(names), bool),
        specials={t["content"]: t["id"] for t in spec["added_tokens"]},
    )
    v.whole = _whole(v)
    return v


def _whole(v: Vocabulary) -> np.ndarray:
    """Which symbols encode alone as themselves, proved by merging each one's own bytes."""
    out = np.zeros(len(v.texts), bool)
    for n, text in enumerate(v.texts):
        out[n] = merge(v, split(v, text)) == [n]
    return out


def split(v: Vocabulary, word: bytes) -> list[int]:
    """A word's bytes as symbols; the mark at its end belongs to the last one."""
    atoms = v.atoms
    if v.suffix and word.endswith(v.suffix) and len(word) > len(v.suffix):
        cut = len(word) - len(v.suffix)
        return [atoms[b] for b in word[: cut - 1]] + [v.by_text[word[cut - 1 :]]]
    return [atoms[b] for b in word]


def merge(v: Vocabulary, parts: list[int]) -> list[int]:
    """Exact merging: the pair whose merge comes first, leftmost among equals, until none is left."""
    if len(parts) > LONG_WORD:
        return _merge_long(v, parts)
    pairs = v.by_pair
    parts = list(parts)
    while len(parts) > 1:
        best = min((pairs.get(p, _NEVER) for p in zip(parts, parts[1:])))
        if best == _NEVER:
            break
        a, b = int(v.left[best]), int(v.right[best])
        i, out = 0, []
        while i < len(parts):
            if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                out.append(best)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def _merge_long(v: Vocabulary, parts: list[int]) -> list[int]:
    """The same with a heap of pairs over a linked list, for words of any length."""
    import heapq

    pairs, n = v.by_pair, len(parts)
    sym, after, before = list(parts), [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(pairs[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
    heapq.heapify(heap)
    while heap:
        made, i = heapq.heappop(heap)
        j = after[i] if sym[i] >= 0 else -1
        if j < 0 or pairs.get((sym[i], sym[j])) != made:
            continue
        sym[i], sym[j] = made, -1
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for x in (before[i], i):
            if x >= 0 and after[x] >= 0 and (m := pairs.get((sym[x], sym[after[x]]))) is not None:
                heapq.heappush(heap, (m, x))
    return [s for s in sym if s >= 0]


def propose(v: Vocabulary, word: bytes) -> list[int]:
    """Greedy: the longest symbol that encodes as itself, again and again; empty if bytes are left over."""
    return _greedy(v.proposals, v.longest, word)


def _greedy(find: dict[bytes, int], longest: dict[bytes, int], word: bytes) -> list[int]:
    out, at, n = [], 0, len(word)
    while at < n:
        end = at + longest.get(word[at : at + 4], 3)
        if end > n:
            end = n
        s = find.get(word[at:end])
        while s is None:
            end -= 1
            if end == at:
                return []
            s = find.get(word[at:end])
        out.append(s)
        at = end
    return out


def compatible(v: Vocabulary, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each adjacent pair whether exact merging of both texts together gives just these two symbols.

    Merges are undone from the last one backwards along the seam. Whenever two symbols that touch at the seam
    have a merge that comes before everything undone so far, merging would have joined them: no.
    """
    a, b = first.astype(np.int64).copy(), second.astype(np.int64).copy()
    limit = np.full(len(a), _NEVER)
    good = np.ones(len(a), bool)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live], b[live]
        bad = pair_ranks(v, x, y) < limit[live]
        good[live[bad]] = False
        # undo the later of the two; where equal, the one on the right (its merge came after the left one's)
        go_left = x > y
        can_left, can_right = v.left[x] != x, v.left[y] != y
        take_left = np.where(go_left, can_left, ~can_right & can_left)
        over = bad | (~can_left & ~can_right)
        keep = ~over
        live, x, y, take_left = live[keep], x[keep], y[keep], take_left[keep]
        limit[live] = np.where(take_left, x, y + 1)
        a[live] = np.where(take_left, v.right[x], x)
        b[live] = np.where(take_left, y, v.left[y])
    return good


def pair_ranks(v: Vocabulary, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """What the merge of each pair makes; _NEVER where there is no such merge."""
    keys, made = v.table["keys"], v.table["made"]
    key = first << 32 | second
    at = _places(key, len(keys))
    there = keys[at]
    out = np.where(there == key, made[at], _NEVER)
    on = np.flatnonzero((there != key) & (there >= 0))
    while len(on):
        at[on] = (at[on] + 1) % len(keys)
        there = keys[at[on]]
        same = there == key[on]
        out[on[same]] = made[at[on[same]]]
        on = on[~same & (there >= 0)]
    return out


def merge_many(v: Vocabulary, words: Sequence[list[int]]) -> list[list[int]]:
    """`merge` for many short words at once, one merge of every unfinished word per round."""
    out: list[list[int]] = [[] for _ in words]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(chain.from_iterable(words), np.int64, int(sizes.sum()))
    who = np.flatnonzero(sizes)
    sizes = sizes[who]
    rank = np.full(len(flat), _NEVER)
    rank[:-1] = pair_ranks(v, flat[:-1], flat[1:])
    while len(who):
        starts = np.cumsum(sizes) - sizes
        rank[starts + sizes - 1] = _NEVER
        best = np.minimum.reduceat(rank, starts)
        ended = best == _NEVER
        if ended.any():
            stay = np.repeat(~ended, sizes)
            done, n = flat[~stay].tolist(), sizes[ended]
            for w, s, e in zip(who[ended].tolist(), (np.cumsum(n) - n).tolist(), np.cumsum(n).tolist()):
                out[w] = done[s:e]
            flat, rank = flat[stay], rank[stay]
            who, sizes, best = who[~ended], sizes[~ended], best[~ended]
            if not len(who):
                break
        hit = rank == np.repeat(best, sizes)
        at = np.flatnonzero(hit)
        # in a run like "aaa" the leftmost pair goes first, so every other hit of a run of hits counts
        new_run = np.ones(len(at), bool)
        new_run[1:] = np.diff(at) != 1
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        word_of = np.repeat(np.arange(len(who)), sizes)
        flat[at] = rank[at]
        sizes = sizes - np.bincount(word_of[at], minlength=len(who))
        left = np.ones(len(flat), bool)
        left[at + 1] = False
        flat, rank = flat[left], rank[left]
        # only the pairs of a new symbol with its neighbours are looked up again
        new = at - np.arange(len(at))
        near = np.concatenate([new, new[new > 0] - 1])
        near = near[near < len(flat) - 1]
        rank[near] = pair_ranks(v, flat[near], flat[near + 1])
    return out


def encode_words(v: Vocabulary, found: Sequence[bytes]) -> tuple[list[list[int]], int]:
    """Symbols of each word, and how many words the check sent to exact merging."""
    find, longest = v.proposals, v.longest
    tokens = [_greedy(find, longest, w) if len(w) <= LONG_WORD else [] for w in found]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    flat = np.fromiter(chain.from_iterable(tokens), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(tokens)), sizes)
    touch = owner[:-1] == owner[1:]
    good = compatible(v, flat[:-1][touch], flat[1:][touch])
    failed = np.union1d(owner[:-1][touch][~good], np.flatnonzero(sizes == 0)).tolist()
    short = [i for i in failed if len(found[i]) <= LONG_WORD]
    for i, symbols in zip(short, merge_many(v, [split(v, found[i]) for i in short])):
        tokens[i] = symbols
    for i in failed:
        if len(found[i]) > LONG_WORD:
            tokens[i] = merge(v, split(v, found[i]))
    return tokens, len(failed)


class Memory(dict):
    """What was worked out for a word, for as long as there is room."""

    def __init__(self, limit: int = MEMORY):
        super().__init__()
        self.limit = limit

    def room_for(self, more: int) -> None:
        if len(self) + more > self.limit:
            self.clear()


def batches(texts: Iterable[str], chars: int, least: int = 0) -> Iterable[list[str]]:
    """Consecutive texts of about `chars` characters together; a text counts as `least` characters at least."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += max(len(t), least)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group
