"""Operators 11 to 13 against brute force and the library, and their defined results for odd input."""

import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberlens.llm import queries, resampling, vector_codes, word_bpe

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, ids string, row string"
ODD = [
    None, "", " \n\t", "ΑΣ ΟΔΟΣ Σ", "İstanbul Ǆ ﬁ", "a<|endoftext|><|STARTOFTEXT|> <|startoftext|>'s", "don't 'LL we'Re", "é ṩ ̈́", "१२ Ⅷ ½ 12345", "🤦🏼‍♂️ 𝔘𝔫𝔦", "\x1c\x1d a\x85b\x00",
    "new letters ᲉꟋ", "x" * 700, "abcdefgh" * 3000, "word " * 5000,
]


def sha(data):
    return hashlib.sha256(data).hexdigest()


# ---- 11
def library():
    t = Tokenizer.from_file(queries.tokenizer_file())
    t.no_truncation()
    t.no_padding()
    return t


def expected(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_word_bpe_odd_texts(spark):
    t, coder = library(), word_bpe.WordCoder(queries.tokenizer_file())
    rng = random.Random(11)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0xE000, 0x20000), 39, 32, 10])) for _ in range(rng.randrange(30))) for _ in range(800)]
    for text, ids in zip(texts, coder.encode([x or "" for x in texts]), strict=True):
        want, decoded = expected(t, text)
        assert ids.tolist() == want and coder.decode(ids).decode() == decoded and coder.spelled(ids).decode() == " ".join(map(str, want)), text[:80]
    docs = spark.createDataFrame([(i, x, "clash", "clash") for i, x in enumerate(ODD + ["twice"])] + [(len(ODD), "twice", None, None), (None, "no id", None, None)], DOCS)
    got = sorted(word_bpe.word_round_trip(docs, queries.tokenizer_file()).collect(), key=str)
    want = []
    for i, x in [*enumerate(ODD + ["twice"]), (len(ODD), "twice"), (None, "no id")]:
        ids, decoded = expected(t, x)
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(decoded.encode())))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: f"Row(doc_id={r[0]}, n_tokens={r[1]}, ids_sha256='{r[2]}', decoded_sha256='{r[3]}')")
    encoded = word_bpe.encode_words(docs, queries.tokenizer_file())
    back = {r.doc_id: (r.ids, r.decoded) for r in word_bpe.decode_words(encoded, queries.tokenizer_file()).collect()}
    assert all(back[i] == tuple(expected(t, x)) for i, x in enumerate(ODD))
    assert word_bpe.word_round_trip(docs.where("false"), queries.tokenizer_file()).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        word_bpe.decode_words(spark.createDataFrame([(1, [70000])], "doc_id long, ids array<int>"), queries.tokenizer_file()).collect()


def test_word_bpe_table(spark):
    t = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_word_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, decoded = expected(t, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(decoded.encode()))


def test_word_bpe_skips_stale_pairs_and_forgets(monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHED_PIECES", 3)
    t, coder = library(), word_bpe.WordCoder(queries.tokenizer_file())
    for text in ("the quick brown fox", "jumps over lazy dogs", "the quick brown fox", "x" * 300 + " y"):
        assert coder.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_are_refused(tmp_path):
    spec = json.load(open(queries.tokenizer_file(), encoding="utf-8"))
    spec["model"]["unk_token"] = "a"
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="no lower-case BPE"):
        word_bpe.WordCoder(str(tmp_path / "t.json"))


# ---- 12
def slow_resample(docs, target, words=1, buckets=10000, seed="2024", percent=10, least=20):
    split = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    runs = lambda w: [b" ".join(w[i : i + k]) for k in range(1, words + 1) for i in range(len(w) - k + 1)]
    features = lambda t: [zlib.crc32(x) % buckets for x in runs(split(t))]
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in features(text):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for n, (i, text) in enumerate(docs):
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = None if i is None else int(sha(f"{seed}:{i}".encode())[:8], 16)
        out.append([i, len(f), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(split(text)), n])
    able = sorted((r for r in out if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0], r[6]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def resampled(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling(spark, monkeypatch):
    monkeypatch.setattr(resampling, "MERGE_ROWS", 40)
    monkeypatch.setattr(resampling, "BLOCK", 97)
    rng = random.Random(12)
    names = ["alpha", "Beta", "GAMMA", "ÄRA", "ära", "don't", "x-1", "9", "日本", "q" * 60]
    docs = [(i, " ".join(rng.choices(names, k=rng.choice([3, 19, 20, 25, 60])))) for i in range(900)]
    docs += [(1000, None), (1001, ""), (1002, "  ...  "), (1003, "word " * 40_000), (None, "no id " * 30)] + [(1004 + i, "the same text " * 10) for i in range(60)]
    target = ["alpha beta", "ära", None, "q" * 60]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, score string, row string").repartition(7)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    assert resampled(resampling.resample(df, aim)) == slow_resample(docs, target)
    three = resampling.resample(df, aim, words=3, buckets=50, percent=60, least_words=1)
    assert resampled(three) == slow_resample(docs, target, words=3, buckets=50, percent=60, least=1)
    twice = spark.createDataFrame([(5, "a b " * 20)] * 30, "doc_id long, text string")
    ranks = sorted(r.rank for r in resampling.resample(twice, aim).collect() if r.rank)
    assert ranks == [1, 2, 3]
    assert resampling.resample(df.where("false"), aim).count() == 0
    assert resampled(resampling.resample(df, aim.where("false"))) == slow_resample(docs, [])


def test_tournament():
    rng = random.Random(3)
    for k in (1, 2, 3, 7, 16, 33):
        runs = [sorted((rng.randrange(20), i, j) for j in range(rng.randrange(9))) for i in range(k)]
        tree = resampling.Tournament(runs)
        assert [tree.pop() for _ in range(sum(map(len, runs)))] == sorted(x for r in runs for x in r)


def test_a_range_stops_at_the_draw():
    part = pa.table({"run": [1, 0, 1, 0], "row": [4, 1, 3, 2], "score": [5, 9, 7, 5], "doc_id": [8, 1, 2, 7], "place": [1, 0, 0, 1], "start": [10] * 4})
    assert resampling.merged(part, 13).to_pydict() == {"row": [1, 3, 2], "rank": [11, 12, 13]}
    assert resampling.merged(part, 99)["rank"].to_pylist() == [11, 12, 13, 14]


# ---- 13
def slow_codes(rows, parts, entries, rounds, unit=4096):
    kept = sorted((i, [math.floor(unit * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(part(v, p), c)), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(v, p)[1], []).append(part(v, p))
            books[p] = [[sum(x) // len(x) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(books[p])]
    got = [(i, [near(v, p) for p in range(parts)], label) for i, v, label in kept]
    total = {}
    for _, n, label in got:
        total[label] = total.get(label, 0) + sum(d for d, _ in n)
    digest = sha(",".join(str(x) for p in books for c in p for x in c).encode())
    return sorted(((i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), total[label], digest) for i, n, label in got), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, code string, ints int"


@pytest.mark.parametrize("grain", [3, 40, 4000])
def test_vector_codes(spark, monkeypatch, grain):
    monkeypatch.setattr(vector_codes, "BLOCK", 50)
    rng = np.random.default_rng(grain)
    rows = [(i, [float(x) for x in np.float32(rng.integers(-grain, grain, 8) / 512)], int(rng.integers(0, 3)) or None) for i in range(400)]
    rows += [(900, None, 1), (901, [], 1), (902, [1.0, None] * 4, 1), (903, [math.nan] * 8, 1), (904, [math.inf] * 8, 2), (905, [0.0] * 8, 2), (906, list(rows[3][1]), None), (907, [-0.00001] * 8, 7)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(5)
    got = sorted((tuple(r) for r in vector_codes.codes(df, 4, 6, 5).collect()), key=str)
    assert got == slow_codes(rows, 4, 6, 5)
    _, _, scans = vector_codes.fit(df, 4, 6, 5)
    assert scans[0] == 4 * 403 and scans[-1] < scans[0]


def test_vector_codes_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1, "", 0), (2, [1.0, 2.0], 1, "", 0), (3, [9.0, 9.0, 9.0], 1, "", 0), (None, [4.0, 4.0], None, "", 0), (2, [1.0, 2.0], None, "", 0)], VECTORS)
    got = {(r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.codes(df, 2, 16, 3).collect()}
    assert got == {(1, "0000", 0, 0), (2, "0000", 0, 0), (None, "0303", 0, 0)}  # equal entries: the lower index
    assert vector_codes.codes(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.codes(df, 8)
    with pytest.raises(Exception, match="beyond"):
        vector_codes.codes(df.union(spark.createDataFrame([(7, [1e30, 0.0], 1, "", 0)], VECTORS)), 2).collect()


def test_roots():
    x = np.array([0, 1, 2, 3, 4, 99, 100, 101, 2**52 + 1, (2**31 - 1) ** 2, (2**31 - 1) ** 2 + 1, 2**61 - 1], np.int64)
    assert vector_codes.root_up(x).tolist() == [-math.isqrt(-(-v)) if v == 0 else math.isqrt(v - 1) + 1 for v in x.tolist()]
    assert vector_codes.root_down(x).tolist() == [math.isqrt(v) for v in x.tolist()]


def test_bounds_hold(spark):
    rng = np.random.default_rng(5)
    rows, books = rng.integers(-500, 500, (300, 4)), rng.integers(-500, 500, (7, 4))
    entry, upper, lower = vector_codes.full_scan(rows, books)
    for _ in range(6):
        fresh = books + rng.integers(-40, 40, books.shape)
        entry, upper, lower, _ = vector_codes.assign(rows, fresh, vector_codes.root_up(((fresh - books) ** 2).sum(1)), entry, upper, lower)
        books = fresh
        d = vector_codes.distances(rows, books)
        assert (entry == d.argmin(1)).all()
        own = d[np.arange(300), entry]
        d[np.arange(300), entry] = 1 << 60
        assert (upper**2 >= own).all() and (lower**2 <= d.min(1)).all()
