"""Periodic runs, substring dedup and vector codes against brute force and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tapeaudit.llm import periodic_runs, queries, substring_dedup, vector_codes

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = "doc_id bigint, text string, chunk bigint, fp string, copies bigint, runs int, n_words string, bucket int, id string, removed int"
LONG = "sed ut perspiciatis unde omnis iste natus error sit voluptatem " * 9000
ODD = [
    (1, None), (2, ""), (3, " \n\t \x0b\x0c\r "), (4, LONG), (5, LONG), (5, LONG), (None, LONG[:900] + "end"), (None, None), (None, "a b"), (None, "a b"),
    (7, "x " * 30), (7, "one text"), (8, "\x1ca\x1db\u00a0c\u2003d 中文 É"), (9, "w"), (10, " ".join(map(str, range(19)))), (11, " ".join(map(str, range(20)))),
    (12, " ".join(map(str, range(20)))),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "f", 1, 1, "n", 1, "i", 1) for i, t in ODD], NAMES)


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q) and not any(s <= start and start + length <= s + k and q % p == 0 for s, k, p in found):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check_runs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in periodic_runs.periodic_runs(df).collect():
        words = SPACE.findall(texts[r.doc_id] or "")
        want = brute_runs(words)
        assert [tuple(x) for x in r.runs] == want, (r.doc_id, texts[r.doc_id][:200])
        assert (r.n_words, r.text) == (len(words), brute_collapse(words, want))


def test_runs_of_random_texts(spark):
    rng, texts = random.Random(3), []
    for _ in range(400):
        n, letters = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 5])
        words = [rng.choice("abcde"[:letters]) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = rng.randrange(1, 12)
            words[a:] = [words[a + (i - a) % p] if a + (i - a) % p < n else "z" for i in range(a, n)]
        texts.append(rng.choice([" ", "\n", "  \t"]).join(words))
    check_runs(spark, texts)


def test_runs_touch_and_overlap(spark):
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    thue = [bin(i).count("1") % 2 for i in range(512)]
    check_runs(spark, [
        " ".join(fib[-1]), " ".join(map(str, thue)), "a " * 5, "a " * 6, "a b " * 3 + "a", "a b " * 4, "a a a a a a b a a a a a a b " * 5, "a " * 6 + "b " * 6,
        "a b a b a b a b a a b a a b a a b a a b", "x y z " * 4 + "x y z " + "w " + "x y z " * 4, "p " * 300, "p q " * 200 + "p " * 200,
    ])


def test_runs_of_all_documents_by_brute_force(spark):
    docs = queries.planted_repeats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    texts = [r.text for r in docs.collect() if len(r.text or "") < 6000]
    assert len(texts) > 100
    check_runs(spark, texts)


def test_runs_odd_rows(spark, odd):
    rows = periodic_runs.periodic_runs(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
    by = {(r.doc_id, r.n_words): r for r in rows}
    assert by[1, 0].runs == [] and by[1, 0].text == "" and by[3, 0].text == "" and by[9, 1].text == "w"
    assert [tuple(x) for x in by[4, 90000].runs] == [(0, 90000, 10)] and len(by[4, 90000].text.split(" ")) == 10
    assert by[8, 3].text == ODD[12][1] and by[8, 3].runs == []
    assert [tuple(x) for x in by[7, 30].runs] == [(0, 30, 1)]
    assert periodic_runs.periodic_runs(odd.limit(0)).collect() == []


def brute_substrings(rows, size):
    """Corpus order is that of the list."""
    seen, out = set(), []
    for text in rows:
        words = SPACE.findall(text or "")
        gone = set()
        for s in range(len(words) - size + 1):
            w = tuple(words[s : s + size])
            if w in seen:
                gone.update(range(s, s + size))
            seen.add(w)
        spans, at = [], sorted(gone)
        for i in at:
            if spans and spans[-1][1] == i:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i, i + 1))
        out.append((len(words), len(gone), spans, " ".join(x for i, x in enumerate(words) if i not in gone)))
    return out


@pytest.mark.parametrize("chunk_bytes", [200, 5000, None])
def test_substrings_of_random_texts(spark, chunk_bytes):
    rng = random.Random(5)
    shared = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(3, 40))] for _ in range(12)]
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(0, 6)):
            words += rng.choice(shared) if rng.random() < 0.5 else [str(rng.random()) for _ in range(rng.randrange(1, 12))]
        texts.append(" ".join(words) if rng.random() < 0.95 else None)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(5)
    for size in (4, 20):
        got = {r.doc_id: r for r in substring_dedup.substring_dedup(df, size=size, chunk_bytes=chunk_bytes).collect()}
        for i, want in enumerate(brute_substrings(texts, size)):
            assert (got[i].n_words, got[i].n_removed, [tuple(x) for x in got[i].removed], got[i].text) == want, i


def test_substring_odd_rows(spark, odd):
    for chunk_bytes in (1000, None):
        rows = substring_dedup.substring_dedup(odd, chunk_bytes=chunk_bytes).collect()
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
        by = {}
        for r in rows:
            by.setdefault((r.doc_id, r.n_words), []).append((r.n_removed, r.text))
        # the first period and the words before its first repeated window stay
        assert by[4, 90000][0][0] == 90000 - 10 and sorted(x for x, _ in by[5, 90000]) == [90000, 90000]
        assert by[1, 0] == [(0, "")] and by[7, 30] == [(29, "x")] and by[10, 19][0][0] == 0
        assert by[11, 20][0][0] == 0 and by[12, 20] == [(20, "")] and by[None, 2] == [(0, "a b"), (0, "a b")]
    assert substring_dedup.substring_dedup(odd.limit(0)).collect() == []


def test_copies_without_id_and_text_ids(spark):
    text = " ".join(f"w{i}" for i in range(25))
    none = spark.createDataFrame([(None, text)] * 3, "doc_id string, text string")
    assert sorted(r.n_removed for r in substring_dedup.substring_dedup(none).collect()) == [0, 25, 25]
    ids = spark.createDataFrame([("b", text), ("", text), ("<a", text)], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(ids, chunk_bytes=50).collect()} == {"": 0, "<a": 25, "b": 25}


def test_texts_are_shuffled_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    df = substring_dedup.substring_dedup(docs)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan


def brute_codes(vectors):
    """Codes, errors and codebooks with Python's integers; vectors in order of id."""
    wide = len(vectors[0]) // 16
    parts = [[tuple(v[p * wide : (p + 1) * wide]) for v in vectors] for p in range(16)]
    books = [list(x[:64]) for x in parts]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(2):
        for p in range(16):
            mine = [nearest(books[p], x)[1] for x in parts[p]]
            for k in range(len(books[p])):
                own = [x for x, m in zip(parts[p], mine) if m == k]
                if own:
                    books[p][k] = tuple(sum(c) // len(own) for c in zip(*own))
    best = [[nearest(books[p], x) for x in parts[p]] for p in range(16)]
    return [("".join(f"{best[p][i][1]:02x}" for p in range(16)), sum(best[p][i][0] for p in range(16))) for i in range(len(vectors))], books


@pytest.mark.parametrize("dims,n,spread", [(64, 300, 1.0), (16, 200, 0.02), (32, 40, 30.0), (48, 1, 1.0)])
def test_codes_of_random_vectors(spark, dims, n, spread):
    rng = np.random.default_rng(dims)
    values = (rng.normal(size=(n, dims)) * spread).astype(np.float32)
    values[: n // 3] = values[0]  # a hot group of equal vectors, so equal entries as well
    df = spark.createDataFrame([(i, v.tolist(), i % 3 or None) for i, v in enumerate(values)], "vec_id int, embedding array<float>, label int").repartition(4)
    coded, books = vector_codes.vector_codes(df)
    want, want_books = brute_codes([[int(x) for x in np.floor(v.astype(np.float64) * 256)] for v in values])
    got = {r.vec_id: r for r in coded.collect()}
    assert [(got[i].code, got[i].error) for i in range(n)] == want
    assert [[tuple(e) for e in b] for b in books.tolist()] == want_books
    for i in range(n):
        assert got[i].label_error == sum(e for j, (_, e) in enumerate(want) if j % 3 == i % 3)


def test_codes_odd_rows(spark):
    one = [0.5] * 16
    rows = [
        (1, one, 1), (2, None, 1), (3, one[:-1] + [None], 1), (4, one[:-1] + [float("nan")], 1), (5, one[:-1] + [float("inf")], 1), (6, [], 1), (7, one * 2, 2),
        (8, [1e30] * 16, None), (0, [], 2), (0, [1.0], 2), (None, [0.25] * 16, None), (None, one, None), (1, [-0.001] * 16, 3),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, code string, salt int")
    coded, books = vector_codes.vector_codes(df)
    got = sorted((r.vec_id is None, r.vec_id or 0, r.code is None, r.code or "", r.error, r.label_error) for r in coded.collect())
    zero, one_, two = "00" * 16, "01" * 16, "02" * 16
    # the id decides the order of the codebook, then the values: -0.001 (-1), 0.5 (128), then the rows without an id
    assert books.shape == (16, 4, 1) and books[0, :, 0].tolist() == [-1, 128, 64, 128]
    assert got == [
        (False, 0, True, "", None, None), (False, 0, True, "", None, None),
        (False, 1, False, zero, 0, 0), (False, 1, False, one_, 0, 0), (False, 6, True, "", None, 0), (False, 7, True, "", None, None), (False, 8, True, "", None, 0),
        (True, 0, False, one_, 0, 0), (True, 0, False, two, 0, 0),
    ]
    assert vector_codes.vector_codes(df.limit(0))[0].collect() == []
    assert vector_codes.vector_codes(df.filter("vec_id = 6"))[0].collect()[0].code is None


def test_hot_labels_meet_their_sums_in_salted_groups(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "small_enough", lambda df: False)
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=16).tolist(), None if i % 2 else i % 5) for i in range(100)], "vec_id int, embedding array<float>, label int")
    rows = vector_codes.vector_codes(df)[0].collect()
    assert len(rows) == 100
    total = sum(r.error for r in rows if r.vec_id % 2)
    assert {r.label_error for r in rows if r.vec_id % 2} == {total}
