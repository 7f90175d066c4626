"""The corpus operators against SQL, the vocabularies' own libraries, brute force and odd rows."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import oracle
from tapeaudit import llm
from tapeaudit.llm import bpe, bpe_codec, components, decontaminate, exact_dedup, language_id, line_dedup, lm_score, minhash, sharding, token_counts, warc
from tapeaudit.llm.queries import vocabulary_path

SF_DIR = "/root/testdata/sf0.001"
BYTE, WORD = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h1 bigint, words string, class string, size int"
LONG = "lorem ipsum dolor sit amet " * 9000
ODD = [
    (1, None, "en", None, 0, 1, "x", "c", 1), (2, "", None, "s", None, None, None, None, None), (3, "  \n\n \n ", "en", "s", 3, 1, "x", "c", 1),
    (4, LONG, "la", "s", 1, 1, "x", "c", 1), (5, LONG, None, None, 1, 1, "x", "c", 1), (5, LONG, None, None, 1, 1, "x", "c", 1),
    (None, "One line\nTwo line\nThree line\nFour", "en", "s", 1, 1, "x", "c", 1), (None, None, None, None, None, None, None, None, None),
    (7, "One line\nTwo line\nThree line\nFive", "en", "s", 1, 1, "x", "c", 1), (7, "another text with the same id", "en", "s", 1, 1, "x", "c", 1),
    (8, "<|endoftext|> a<|startoftext|>É ΑΣ 中文 \t!", "el", "s", 1, 1, "x", "c", 1), (9, "123 ... !!!", "en", "s", 1, 1, "x", "c", 1), (10, "word", "en", "s", 1, 1, "x", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one line two", 5), (None, "line three line four", 5), (2, None, 1), (3, "", 1), (3, " !! ", 1)], "item_id int, text string, start int")


OPERATORS = {
    "line_dedup": lambda d, i: line_dedup.line_dedup(d),
    "language_id": lambda d, i: language_id.language_id(d),
    "lm_score": lambda d, i: lm_score.cross_entropy_difference(d, d.select("doc_id").limit(2)),
    "exact_dedup": lambda d, i: exact_dedup.exact_dedup(d),
    "bpe": lambda d, i: bpe_codec.encode_decode(d, BYTE),
    "decontaminate": lambda d, i: decontaminate.decontaminate(d, i),
    "minhash": lambda d, i: minhash.near_dedup(d),
    "token_counts": lambda d, i: token_counts.token_counts(d, WORD),
    "sharding": lambda d, i: sharding.shard(d, 24),
    "warc": lambda d, i: warc.round_trip(d, "doc_id", "source", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_once_and_empty_tables(spark, odd, items, name):
    got = OPERATORS[name](odd, items).select("doc_id").collect()
    assert Counter(r[0] for r in got) == Counter(r[0] for r in ODD)
    assert OPERATORS[name](odd.limit(0), items.limit(0)).collect() == []
    assert OPERATORS[name](odd.limit(0), items).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, odd, name, stage):
    out = stage(spark, odd, SF_DIR)
    out.collect()
    if name != "bpe":
        assert out.columns == corpus_pipeline.COLUMNS
    assert stage(spark, odd.limit(0), SF_DIR).collect() == []


@pytest.mark.parametrize("name", llm.ORACLES)
def test_oracles(spark, name):
    assert oracle.compare(llm.QUERIES[name](spark, SF_DIR), oracle.connect(SF_DIR), llm.ORACLES[name]) is None


def test_line_dedup_odd_rows(odd):
    out = {(r.doc_id, r.text): r for r in line_dedup.line_dedup(odd).collect()}
    assert (None, "Four") in out and (7, "One line\nTwo line\nThree line\nFive") in out  # the row without an id comes last
    assert (3, "  \n\n \n ") in out and (1, None) in out and out[1, None].n_lines == 0


def test_line_dedup_merges_overlapping_windows(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\nd\ny\nb\nc\nd"), (3, "c\nd"), (4, "a\nb\nc\nd\ne")]
    out = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert out == {1: (rows[0][1], 0), 2: ("x\ny", 7), 3: ("c\nd", 0), 4: ("", 5)}


def test_line_dedup_orders_rows_of_one_id_or_none(spark):
    head = "one head\ntwo head\nthree head\n"
    for i, j in ((None, None), (3, 3)):
        rows = [(i, head + "left"), (j, head + "right"), (j, head + "middle")]
        out = sorted((r.n_removed, r.text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect())
        assert [n for n, _ in out] == [0, 3, 3] and out[2][1] in ("left", "right", "middle") and out[0][1].startswith(head)


def test_exact_dedup_compares_bytes_inside_groups(spark, odd):
    weak = exact_dedup.exact_dedup(odd, fingerprint=lambda t: F.substring(F.md5(t), 1, 1))
    key = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(str, weak.select(key).collect())) == sorted(map(str, exact_dedup.exact_dedup(odd).select(key).collect()))
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in weak.collect()}
    assert {(4, 5, 3, False), (5, 5, 3, True), (None, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True)} <= got


def test_sharding_moves_rows_into_the_new_shard_only(spark):
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"))
    rows = sharding.shard(ids, 24).collect()
    assert all(r.grown_shard in (r.shard, 24) for r in rows) and sum(r.grown_shard == 24 for r in rows) < 3000 / 25 * 1.5
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(slots) == 24 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.size for r in rows} == {10}
    grown = {r.doc_id: r.shard for r in sharding.shard(ids, 25).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in rows)


def texts():
    rng = random.Random(5)
    docs = [t or "" for t in pq.read_table(f"{SF_DIR}/documents.parquet").column("text").to_pylist()]
    letters = "abAB  \n\t'’sStT123éÉÇß²½ΣσςİıǅЖя中文‍ \x1c\x85😀́ﬁŉ"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    planes = ["".join(map(chr, range(c, c + 64))) for c in itertools.chain(range(0, 0xD800, 64), range(0xE000, 0x11000, 64))]
    return docs + odd + planes + ["<|endoftext|>", "a<|endoftext|> b <|startoftext|>  <|endoftext|", "x" * 5000, "ab" * 3000, " " * 3000 + "a", LONG]


def test_bpe_equals_the_library():
    lib, codec = Tokenizer.from_file(BYTE), bpe_codec.Codec(bpe_codec.vocabulary(BYTE), bpe.Memory(5000))
    all_texts = texts()
    want = [e.ids for e in lib.encode_batch(all_texts, add_special_tokens=False)]
    got = [x for group in bpe.batches(all_texts, 100_000) for x in codec.encode(group)]
    assert [x for x, _ in got] == want and [s for _, s in got] == [",".join(map(str, x)) for x in want]
    assert [codec.decode(x) for x in want] == lib.decode_batch(want, skip_special_tokens=False) == all_texts


def test_pair_check_agrees_with_merging():
    v = bpe_codec.vocabulary(BYTE)
    rng = np.random.default_rng(1)
    common = rng.integers(0, 3000, (4000, 2))
    ok = bpe.compatible(v, common[:, 0], common[:, 1])
    exact = [bpe.merge(v, bpe.split(v, v.texts[a] + v.texts[b])) == [a, b] for a, b in common]
    assert ok.tolist() == exact and 100 < ok.sum() < 3900


def test_token_counts_equal_the_library():
    lib, v = Tokenizer.from_file(WORD), bpe_codec.vocabulary(WORD)
    counter = token_counts.Counter(v, token_counts.whole_words(v), bpe.Memory(60_000))
    all_texts = texts()
    got = [n for group in bpe.batches(all_texts, 100_000) for n in counter.count(group)]
    assert got == [len(e.ids) for e in lib.encode_batch(all_texts, add_special_tokens=False)]


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.language_id(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_ignores_held_out_labels(spark, odd):
    out = {(r.doc_id, r.lang_pred) for r in language_id.language_id(odd).collect()}
    assert (1, "und") in out and (9, "und") in out and (3, "und") in out
    assert {x for _, x in out} <= {"und", "en", "el", "la"}


@pytest.mark.parametrize("chunk_bytes", [None, 12, 1])
def test_lm_scores_against_a_direct_count(spark, chunk_bytes):
    rows = [(1, "the cat sat"), (2, "the dog sat down"), (3, "a cat"), (4, ""), (5, "The cat sat")]
    out = {r.doc_id: r for r in lm_score.cross_entropy_difference(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([(1,), (2,), (2,)], "d int"), chunk_bytes=chunk_bytes).collect()}
    words = {i: re.findall(r"\w+", t.lower()) for i, t in rows}
    counts = []
    for ids in ((1, 2), (1, 2, 3, 4, 5)):
        pairs = [p for i in ids for p in zip(["<s>", *words[i]], words[i])]
        counts.append((Counter(w for _, w in pairs), Counter(v for v, _ in pairs), Counter(pairs)))
    total = sum(counts[0][0].values())
    vocabulary = len(counts[1][0])

    def loss(i, m):
        uni, context, both = counts[m]
        scale = total / sum(uni.values())
        out = 0.0
        for p in zip(["<s>", *words[i]], words[i]):
            single = (uni[p[1]] * scale + lm_score.ALPHA) / (total + lm_score.ALPHA * vocabulary)
            out -= math.log((both[p] * scale + lm_score.PRIOR * single) / (context[p[0]] * scale + lm_score.PRIOR))
        return out / len(words[i])

    for i in (1, 2, 3, 5):
        assert out[i].target_loss == pytest.approx(loss(i, 0)) and out[i].background_loss == pytest.approx(loss(i, 1))
        assert out[i].score == pytest.approx(loss(i, 0) - loss(i, 1)) and out[i].n_tokens == len(words[i])
    assert out[4].score is None and out[3].score > out[2].score


def test_lm_scores_of_all_documents_against_a_direct_count(spark):
    """Pairs met once, in target and background, and words that are everywhere, over several chunks."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").filter("quality = 1").collect()}
    texts = {r.doc_id: re.findall(r"\w+", (r.text or "").lower()) for r in docs.collect()}
    seen = []
    for ids in (good & texts.keys(), texts):
        both = Counter(p for i in ids for p in zip(["<s>", *texts[i]], texts[i]))
        uni, context = Counter(), Counter()
        for (v, w), n in both.items():
            uni[w] += n
            context[v] += n
        seen.append((uni, context, both))
    total, vocabulary = sum(seen[0][0].values()), len(seen[1][0])
    assert sum(n == 1 for n in seen[1][2].values()) > 100
    wanted = spark.createDataFrame([(i,) for i in good], "d bigint")
    for r in lm_score.cross_entropy_difference(docs, wanted, chunk_bytes=50_000).collect():
        losses = []
        for uni, context, both in seen:
            scale = total / sum(uni.values())
            said = [
                -math.log((both[p] * scale + lm_score.PRIOR * (uni[p[1]] * scale + lm_score.ALPHA) / (total + lm_score.ALPHA * vocabulary)) / (context[p[0]] * scale + lm_score.PRIOR))
                for p in zip(["<s>", *texts[r.doc_id]], texts[r.doc_id])
            ]
            losses.append(sum(said) / len(said) if said else None)
        assert r.n_tokens == len(texts[r.doc_id])
        assert [r.target_loss, r.background_loss] == (pytest.approx(losses) if losses[0] is not None else [None, None])


def shingle_bag(text):
    w = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def weighted_jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def brute_classes(rows):
    bags = {i: shingle_bag(t) for i, t in rows}
    parent = {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(bags, 2):
        if bags[a] and bags[b] and weighted_jaccard(bags[a], bags[b]) >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in bags}


def near_rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 260):  # a star: each is like the first one, few are like each other
        own = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    for i in range(260, 300):
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))))
    rows += [(300 + i, rows[rng.randrange(300)][1].upper()) for i in range(40)] + [(340, "only two"), (341, "Only  two!"), (342, ""), (343, None)]
    chain = [f"c{i}" for i in range(100)]
    return rows + [(350 + k, " ".join(chain[5 * k : 5 * k + 70])) for k in range(6)]


def test_near_dedup_against_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(7)
    want = brute_classes(rows)
    for block in (128, 16):
        got = {r.doc_id: r for r in minhash.near_dedup(docs, block=block).collect()}
        assert {i: r.class_id for i, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got.values())
    assert sorted(r.doc_id for r in minhash.keep_one(docs).collect()) == sorted(set(want.values()))


def test_near_dedup_on_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in minhash.near_dedup(docs).collect()} == brute_classes(rows)


def test_near_dedup_keeps_one_row_of_each_class(spark):
    one, two, three, four = (" ".join(f"{p}{k}" for k in range(60)) for p in "abcd")
    rows = [(None, one), (None, one + " more"), (None, one), (5, two), (5, two + " more"), (6, two), (7, three), (7, three), (8, three), (9, four), (9, four), (None, four)]
    docs = spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(rows)], "doc_id int, text string, source string").repartition(5)
    out = minhash.near_dedup(docs).collect()
    assert len(out) == len(rows) and Counter(r.class_size for r in out) == {3: 12}
    assert Counter(r.doc_id for r in out if r.kept) == {None: 1, 5: 1, 7: 1, 9: 1}
    left = minhash.keep_one(docs).collect()
    assert Counter(r.doc_id for r in left) == {None: 1, 5: 1, 7: 1, 9: 1}
    assert all(rows[int(r.source[1:])] == (r.doc_id, r.text) for r in left)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        hashes = rng.integers(0, 2**63, 400).astype(np.uint64)
        n = int(400 * share)
        a, b = np.sort(hashes[:n]), np.sort(hashes)
        wa, wb = np.full(n, 2), np.full(400, 2)
        wb[::10] = 3
        bag_a, bag_b = Counter(dict(zip(a, wa))), Counter(dict(zip(b, wb)))
        s = minhash.dart_minhash([(a, wa), (b, wb)], 2000)
        assert abs((s[0] == s[1]).mean() - weighted_jaccard(bag_a, bag_b)) < 0.05


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100), (60, 50), (50, 61)]
    links = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in pairs], "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.label, "big") for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 60: 50, 61: 50}


def test_decontamination_matches(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("abcdefgh") for _ in range(n))
    bench = [(i, say(rng.choice([1, 2, 5, 13, 30]))) for i in range(12)]
    docs = [(i, f"{say(20)}, {rng.choice(bench)[1].upper()}. {say(30)}") for i in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(bench, "item_id int, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(d, b).collect()}
    for i, text in docs:
        w, hit, found = re.findall(r"[a-z0-9]+", text.lower()), set(), set()
        for item, t in bench:
            v = re.findall(r"[a-z0-9]+", t.lower())
            n = min(13, len(v))
            for k in range(len(v) - n + 1):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[k : k + n]:
                        hit |= set(range(s, s + n))
                        found.add(str(item))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (len(w), len(hit), len(found))
        assert got[i].contaminated == (bool(hit) and 20 * len(hit) >= len(w))


def test_proximity_matches(spark):
    d = spark.createDataFrame([(1, "red one two blue"), (2, "red one two three blue"), (3, "red " + "x " * 9 + "blue")], "doc_id int, text string")
    windows = decontaminate.item_windows(spark.createDataFrame([(1, "red yes so blue")], "item_id int, text string"))
    anchors = windows.select("wid", F.explode(F.expr("array(struct('red' as term, 0 as offset, 0 as role), struct('blue' as term, 3 as offset, 1 as role))")).alias("a")).select("wid", "a.*")
    index = decontaminate.postings(d, anchors.select("term"))
    got = {(r.row_id, r.shift) for r in decontaminate.proximity_matches(index, anchors, 2).collect()}
    assert got == {("1", 0), ("2", 1)}


@pytest.mark.parametrize("range_bytes", [50, 1000, 1 << 20])
def test_warc_ranges_own_each_record_once(spark, tmp_path, range_bytes):
    rng = random.Random(4)
    noise = "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(9000))
    pages = [(i, f"http://x/{i} y", rng.choice(["short", "a" * 200, noise, None, "é" * 50 + str(i)])) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    files = warc.write_archives(df, str(tmp_path / "w"), file_bytes=20_000)
    got = warc.read_archives(spark, files, range_bytes).collect()
    assert sorted(int(r.page) for r in got) == list(range(60))
    html = {i: (h or "").encode() for i, _, h in pages}
    for r in got:
        source = int(r.refers_to) if r.record_type == "revisit" else int(r.page)
        assert html[int(r.page)] == html[source] and (r.payload is None or bytes(r.payload) == html[source])
        assert r.url == f"http://x/{r.page}%20y" and r.payload_bytes == len(html[source])


def test_warc_refuses_a_damaged_payload(spark, tmp_path):
    good = warc._page_record("1", "u", "payload", "0" * 64, 7, None, "2000-01-01T00:00:00Z")
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"noise\x1f\x8b\x08noise" + good)
    files = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, length bigint")
    with pytest.raises(Exception, match="recorded length or digest"):
        warc.read_archives(spark, files).collect()


def test_pipeline_drops_contaminated_rows_and_no_others(spark):
    passage = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").filter("size(split(text, ' ')) >= 13").first().text
    rows = [(None, passage), (None, "clean and without an id"), (1, passage + " x"), (1, "clean under the same id"), (2, "clean")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.without_benchmark(spark, docs, SF_DIR)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([rows[1], rows[3], rows[4]])


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {name: None for name, _ in corpus_pipeline.STAGES}
    at, stored = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.asDict() for r in at.collect()}
        at = stage(spark, at, SF_DIR)
        at = spark.createDataFrame(at.toPandas(), at.schema)
        stored[name] = before, {r.doc_id: r.asDict() for r in at.collect()}
    before, after = stored["language_id"]
    assert all(before[i] == r for i, r in after.items()) and {i for i in before if re.search(r"[^\W\d_]", before[i]["text"] or "")} == set(after)
    before, after = stored["line_dedup"]
    seen = set()
    for i in sorted(before):
        lines = before[i]["text"].split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if any(x.strip() for x in window):
                gone |= {k, k + 1, k + 2} if window in seen else set()
                seen.add(window)
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert (i not in after) if len(gone) == len(lines) else (after[i]["text"] == left and (not gone or after[i]["n_chars"] == len(left)))
    before, after = stored["minhash_near_dedup"]
    assert set(after) == set(brute_classes([(i, r["text"]) for i, r in before.items()]).values()) and all(before[i] == r for i, r in after.items())
    before, after = stored["decontaminate"]
    judged = oracle.connect(SF_DIR)
    judged.execute("DROP VIEW documents")
    judged.register("documents", pa.Table.from_pylist(list(before.values())))
    clean = {r[0] for r in judged.sql(f"SELECT doc_id FROM ({llm.ORACLES['op6_decontaminate']}) WHERE NOT contaminated").fetchall()}
    assert set(after) == clean and all(before[i] == r for i, r in after.items())
    before, after = stored["bpe"]
    lib = Tokenizer.from_file(BYTE)
    assert {i: r["n_tokens"] for i, r in after.items()} == {i: len(lib.encode(r["text"], add_special_tokens=False).ids) for i, r in before.items()}
    assert sorted(map(str, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(str, at.collect()))


@pytest.mark.parametrize("range_bytes", [64, 700, 1 << 20])
def test_warc_damage_is_an_error_wherever_it_is(spark, tmp_path, range_bytes):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, f"u{i}", "".join(rng.choice("abcdef ") for _ in range(150))) for i in range(6)], "page_id int, url string, html string")
    (file,) = warc.write_archives(df.coalesce(1), str(tmp_path / "w")).collect()
    whole = pa.fs.LocalFileSystem().open_input_file(file.path.removeprefix("file:")).readall()
    starts = [m.start() for m in re.finditer(re.escape(warc.MAGIC), whole)]

    def read(data):
        ranges = [(at, min(at + range_bytes, len(whole))) for at in range(0, len(whole), range_bytes)]
        return [r for a, b in ranges for r in warc.records(pa.BufferReader(data), len(whole), a, b)]

    assert len(read(whole)) == 7
    for at in {0, 1, starts[1], starts[3] + 2, starts[3] + 40, starts[-1] + 60, len(whole) - 3}:
        with pytest.raises(ValueError):
            read(whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :])
    for cut in (starts[-1], starts[-1] + 5, starts[-1] + 80, len(whole) - 1):
        with pytest.raises(ValueError):
            read(whole[:cut])


def test_warc_text_ids_come_back(spark):
    ids = ["", "<q>", "a b", "é%41", None, "urn:page:x", "ü\n"]
    df = spark.createDataFrame([(i, "u", "x" * 200) for i in ids], "page_id string, url string, html string")
    rows = warc.round_trip(df).collect()
    assert Counter(r.page_id for r in rows) == Counter(ids)
    assert [r.page_id for r in rows if r.record_type == "response"] == [""] and all(r.refers_to == "" for r in rows if r.record_type == "revisit")
