"""The ten operators against brute force, and their defined results for odd input."""

import hashlib
import json
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from emberlens.llm import attribution, bpe, chat, jaccard, line_dedup, media, mixing, neighbours, quality, queries, url_filter
from emberlens.llm.shingles import shingle_set

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **columns):
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def sf(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()


# ---- 1 chat
ODD_TURNS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "[\\INST] <s> \\ </s>"), (2, 0, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", ""),
    (3, None, "tool [SAYS]", "x [/ROLE] y"), (3, 5, "system", " [/SYS]"), (None, 0, "user", "hé [\\\\/INST] \n"), (4, 0, "user", "plain <b> [x]"), (4, 1, "user", " [/INST"), (4, 2, "assistant", "]"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r.conv_id: r for r in chat.format_conversations(df).withColumn("mask", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert set(out) == {1, 2, 3, 4, None}
    for conv_id, r in out.items():
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in ODD_TURNS if c == conv_id))
        assert [(t.role, t.text) for t in r.turns] == [t[1:] for t in turns]
        assert r.mask == "".join(t[2] for t in turns if t[1] == "assistant")
    assert out[1].escaped and out[3].escaped and not out[4].escaped and not out[2].escaped
    assert out[4].formatted == "[INST] plain <b> [x] [/INST][INST]  [/INST [/INST]<s> ] </s>"
    assert chat.format_conversations(df.where("false")).count() == 0


# ---- 2 attribution
def slow_allocate(starts, ends, lows, highs, rule):
    got = [0.0] * len(lows)
    for s, e in zip(starts, ends):
        over = [max(0, min(e, h) - max(s, low)) for low, h in zip(lows, highs)]
        met = [i for i, o in enumerate(over) if o > 0]
        if met and rule == "split":
            for i in met:
                got[i] += over[i] / sum(over)
        elif met:
            got[met[0] if rule == "first" else max(met, key=lambda i: (over[i], -i))] += 1
    return got


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution(spark, rule):
    texts = ["", None, "a\nb", "Höhe 🤦🏼‍♂️ und\n\n  Maße don't", "word " * 3000]
    df = docs_of(spark, texts)
    parts = [("source", F.col("source")), ("text", F.col("text")), ("none", F.lit(None)), ("lang", F.col("lang"))]
    got = {(r.doc_id, r.section): r for r in attribution.attribute_tokens(attribution.record_of(df, parts), queries.ranks_file(), P.PATTERN, rule).collect()}
    enc, _ = attribution.load_encoding(queries.ranks_file(), P.PATTERN)
    for i, t in enumerate(texts):
        values = [f"s{i % 2}\n", (t or "") + "\n", "\n", "en"]
        record = "".join(values)
        ids = enc.encode_ordinary(record)
        data, at, starts, ends = record.encode(), 0, [], []
        for x in ids:
            token = enc.decode_single_token_bytes(x)
            char = lambda k: len(data[: k + 1].decode("utf-8", "ignore").encode()) and sum((b & 0xC0) != 0x80 for b in data[: k + 1]) - 1  # noqa: B023, E731
            starts.append(max(0, char(at)))
            at += len(token)
            ends.append(char(at - 1) + 1)
        highs = np.cumsum([len(v) for v in values]).tolist()
        want = slow_allocate(starts, ends, [0, *highs[:-1]], highs, rule)
        assert [got[i, n].tokens for n in ("source", "text", "none", "lang")] == pytest.approx(want)
        assert sum(want) == pytest.approx(len(ids)) and got[i, "text"].record_tokens == len(ids)


def test_attribution_query(spark):
    """op2_token_attribution over a whole table against spans counted one by one: a token goes to the section that holds most of it."""
    d = "/root/testdata/sf0.001"
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(queries.ranks_file()), special_tokens={})
    got = {(r.doc_id, r.section): (r.tokens, r.record_tokens) for r in queries.op2_token_attribution(spark, d).collect()}
    docs = duckdb.sql(f"SELECT doc_id, source, lang, text FROM '{d}/documents.parquet'").fetchall()
    assert len(got) == 4 * len(docs)
    for doc_id, source, lang, text in docs:
        head, _, body = (text or "").partition("\n")
        names, values = ("source", "lang", "head", "body"), [f"{source or ''}\n", f"{lang or ''}\n", head + "\n", body]
        owner = [k for k, v in enumerate(values) for _ in v]
        byte_owner = [(i, k) for i, (k, c) in enumerate(zip(owner, "".join(values), strict=True)) for _ in c.encode()]
        counts, at, ids = [0] * 4, 0, enc.encode_ordinary("".join(values))
        for x in ids:
            size = len(enc.decode_single_token_bytes(x))
            chars = [k for _, k in sorted(set(byte_owner[at : at + size]))]
            counts[max(set(chars), key=lambda k: (chars.count(k), -k))] += 1
            at += size
        assert [got[doc_id, n] for n in names] == [(c, len(ids)) for c in counts]


# ---- 3 URL filters
def test_url_filter(spark):
    entries = [("bad.com", "add", "2024-02-01", "spam"), ("bad.com", "remove", "2024-03-01", "spam"), ("bad.com", "remove", "2024-02-01", "spam"), ("a.org/x", "add", "2024-01-01", None), (None, "add", "2024-01-01", "spam"), ("com", "add", None, "spam")]
    e = spark.createDataFrame(entries, "key string, action string, listed_at string, category string").withColumn("listed_at", F.col("listed_at").cast("timestamp"))
    pages = [(1, "http://u@WWW.Bad.com:80/p?q", "2024-02-29 23:59:59"), (2, "http://bad.com./", "2024-03-01 00:00:00"), (3, "https://bad.com", "2024-01-31 00:00:00"), (4, None, "2024-02-10 00:00:00"), (5, "notbad.com", "2024-02-10 00:00:00"), (6, "http://a.org/x#y", "2025-01-01 00:00:00"), (7, "http://notbad.com/", "2024-02-10 00:00:00"), (8, "http://bad.com/", None), (8, "http://bad.com/", None)]
    c = spark.createDataFrame(pages, "page_id long, url string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).withColumn("key", F.lit("clash"))
    got = {r.page_id: (r.blocked, r.hits, r.category, r.matched_key) for r in url_filter.filter_captures(c, e).collect()}
    clear = (False, 0, None, None)
    assert got == {1: (True, 1, "spam", "bad.com"), 2: clear, 3: clear, 4: clear, 5: clear, 6: (True, 1, None, "a.org/x"), 7: clear, 8: clear}
    assert url_filter.filter_captures(c.where("false"), e).count() == 0 and url_filter.filter_captures(c, e.where("false")).where("blocked").count() == 0


# ---- 4 quality
def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op4_quality(spark, d).collect()}
    labels = [r for r in duckdb.sql(f"SELECT doc_id, quality FROM '{d}/labels.parquet'").fetchall()]
    held = [(got[i].score, q) for i, q in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in labels)
    right = np.mean([(s >= 0.5) == q for s, q in held])
    good, bad = np.array([s for s, q in held if q]), np.array([s for s, q in held if not q])
    auc = np.mean(good[:, None] > bad[None, :])
    print("held-out accuracy", right, "AUC", auc)
    assert right > 0.95 and auc > 0.97


def test_quality_edges(spark):
    rng = np.random.default_rng(1)
    texts = ["ab cd " * int(rng.integers(1, 400)) for _ in range(40)] + ["a### b&&& " * int(rng.integers(1, 400)) for _ in range(40)]
    net = quality.train([t.encode() for t in texts], [1] * 40 + [0] * 40, epochs=10)
    df = docs_of(spark, ["", None, "x", texts[0], texts[0], texts[-1], "ab cd " * 100_000]).withColumn("quality_score", F.lit("clash"))
    out = quality.score_documents(df, net).orderBy("doc_id").collect()
    assert all(r.quality_score_ == "clash" for r in out)
    assert [r.n_chars for r in out] == [0, 0, 1, len(texts[0]), len(texts[0]), len(texts[-1]), 600_000]
    s = [r.quality_score for r in out]
    assert s[0] == s[1] and s[3] == s[4] and s[3] > 0.5 > s[5] and s[6] > 0.5 and all(0 <= x <= 1 for x in s)
    pooled, at, raw = quality._pooled(b"abcdefgh" * 300, net.pairs())
    slow = np.array([[sum(net.tables[k, raw[i + k], f] for k in range(quality.WIDTH)) for f in range(quality.FILTERS)] for i in range(len(raw) - quality.WIDTH + 1)])
    want = np.array([slow[i : i + quality.CHUNK].max(0) for i in range(0, len(slow), quality.CHUNK)])
    assert np.allclose(pooled, want, atol=1e-5)
    assert quality.score(b"", quality.train([], []), quality.train([], []).pairs()) == 0.5
    assert quality.score_documents(df.where("false"), net).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (5, 7)], "doc_id long, quality int")
    twice = docs_of(spark, [f"text {i}" for i in range(60)])
    rows_ = quality.training_rows(twice.union(twice.withColumn("text", F.concat("text", F.lit(" again")))), labels, max_rows_per_class=12)
    assert len(rows_) == 24 and not any("again" in t.decode() for t, _ in rows_)
    assert all(zlib.crc32(t.decode().split()[1].encode()) % 3 != 1 for t, _ in rows_)


# ---- 5 line dedup
def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :] or a == b


def slow_dedup(texts, min_chars):
    places = [(i, j, line.strip(" ")) for i, t in enumerate(texts) for j, line in enumerate((t or "").split("\n"))]
    places = [p for p in places if len(p[2]) >= min_chars]
    return {p[:2] for k, p in enumerate(places) if any(near(p[2], q[2]) for q in places[:k])}


def test_line_dedup(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcé "), 40)) + "x" for _ in range(12)]
    texts = ["", None, base[0] + "\n" + base[0], "short\nshort"]
    for _ in range(60):
        out = []
        for _ in range(rng.integers(1, 5)):
            line = base[rng.integers(12)]
            for _ in range(rng.integers(0, 3)):
                i, kind = int(rng.integers(len(line))), rng.integers(3)
                line = line[:i] + ("Z" if kind < 2 else "") + line[i + (kind > 0) :]
            out.append(line + " " * int(rng.integers(3)))
        texts.append("\n".join(out))
    df = docs_of(spark, texts).withColumn("line", F.lit("clash"))
    gone = slow_dedup(texts, 30)
    out = line_dedup.dedup_lines(df).orderBy("doc_id").collect()
    for i, (t, r) in enumerate(zip(texts, out)):
        kept = [x for j, x in enumerate((t or "").split("\n")) if (i, j) not in gone]
        assert r.text == (t if len(kept) == len((t or "").split("\n")) else "\n".join(kept))
        assert r.dedup_removed == len((t or "").split("\n")) - len(kept) and r.line == "clash"
    assert line_dedup.dedup_lines(df.where("false")).count() == 0
    twice = line_dedup.dedup_lines(df.where("doc_id = 2").union(df.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert sorted((str(r.doc_id), r.dedup_removed) for r in twice) == [("2", 1), ("None", 2)]


def test_line_dedup_long_lines_and_common_ones(spark, monkeypatch):
    """Lines of 100,000 code points one edit apart in any part of the line, and a line that is joined in parts."""
    monkeypatch.setattr(line_dedup, "COMMON", 20)
    rng = np.random.default_rng(4)
    base = "a" + "".join(rng.choice(list("abcdé 🤦"), 99_998)) + "x"
    other = "".join(rng.choice(list("abcdé 🤦"), 99_998)) + "x"
    edits = [base, "Z" + base, base[:50_000] + base[50_001:], base[:70_000] + "Z" + base[70_001:], base + "Z", other, base[:10] + "YY" + base[12:]]
    common = "This very line is on every page of the site."
    texts = [*edits, *[common + f"\nA line of page number {i} that is found {'n' * i} nowhere else." for i in range(60)]]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert [i for i in range(len(edits)) if out[i] == ""] == [1, 2, 3, 4] and out[0] == base and out[5] == other and out[6] == edits[6]
    assert out[len(edits)] == texts[len(edits)] and all(common not in out[i] for i in range(len(edits) + 1, len(texts)))


def test_line_dedup_clashing_names(spark):
    df = docs_of(spark, ["a" * 40, "a" * 40]).withColumns({"dedup_removed": F.lit("in"), "line_no": F.lit(5), "h1": F.lit(6), "gone_id": F.lit(7)})
    got = line_dedup.dedup_lines(df).orderBy("doc_id").collect()
    assert [(r.dedup_removed, r.dedup_removed_, r.line_no, r.h1, r.gone_id) for r in got] == [(0, "in", 5, 6, 7), (1, "in", 5, 6, 7)]


# ---- 6 media
def test_media(spark):
    import tarfile

    texts = ["", None, "x" * 64, "é" * 33, "x" * 64, "abc\0" * 50_000, *["copy of a text"] * 30]
    df = docs_of(spark, texts).withColumn("digest", F.lit("clash")).withColumn("key", F.lit("clash")).repartition(4)
    index = media.store_payloads(df)
    full = {r.doc_id: r for r in media.describe(index).collect()}
    heads = media.add_metadata(media.members(index)).collect()
    assert len(heads) == len({media.payload_of(t)[0] for t in texts}) and all(r.header_bytes == 33 for r in heads)
    assert media.members(index).agg(F.sum("length")).first()[0] > 33 * len(heads)
    for i, t in enumerate(texts):
        payload, n = media.payload_of(t)
        assert len(payload) % 64 == 0 < len(payload) and n == len((t or "").encode()) and payload.rstrip(b"\0") == (t or "").encode().rstrip(b"\0")
        assert (full[i].n_bytes, full[i].payload_bytes, full[i].payload_sha256, full[i].tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert full[i].media_sha256 == full[i].digest
        assert (full[i].width, full[i].height, full[i].bit_depth) == (64, len(payload) // 64, 8)
        assert media.decode(media.encode(payload, n)) == (payload, n)
    stored = []
    for shard in {r.shard for r in index.collect()}:
        with tarfile.open(shard) as tar:
            for m in tar.getmembers():
                assert hashlib.sha256(tar.extractfile(m).read()).hexdigest() == m.name
                stored.append(m.name)
    assert sorted(stored) == sorted({r.digest for r in full.values()})  # each once over all shards
    assert full[2].feature == full[4].feature and media.describe(media.store_payloads(df.where("false"))).count() == 0
    with pytest.raises(ValueError):
        media.decode(media.encode(b"a" * 64, 64)[:-20] + bytes(20))


def test_media_query(spark, monkeypatch):
    """Every column of op6_media against a plain recomputation, with the joins in parts."""
    monkeypatch.setattr(media, "COMMON", 3)
    d = "/root/testdata/sf0.001"
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall())
    got = queries.op6_media(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
        lines = b"".join(b"\0" + payload[i : i + 64] for i in range(0, len(payload), 64))
        head = (64).to_bytes(4, "big") + (len(payload) // 64).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", b"Bytes\0%d" % len(raw)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")
        sha = hashlib.sha256(png).hexdigest()
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.member, r.width, r.height, r.bit_depth) == (len(png), sha, sha, 64, len(payload) // 64, 8)
        rows, shares, _, _ = r.feature.split(";")
        assert int(rows) == len(payload) // 64 and [int(x) for x in shares.split(",")] == [sum(b >> 4 == k for b in payload) * 1000 // len(payload) for k in range(16)]
    assert len({(r.feature, r.media_sha256) for r in got}) == len({t or "" for t in texts.values()})


# ---- 7 neighbours
def exact_cosine(v, w):
    """By fractions, rounded once."""
    from decimal import Decimal, getcontext
    from fractions import Fraction

    getcontext().prec = 60
    a, b = [Fraction(float(x)) for x in v], [Fraction(float(x)) for x in w]
    root = lambda f: (Decimal(f.numerator) / Decimal(f.denominator)).sqrt()
    dot = sum(x * y for x, y in zip(a, b))
    return float(Decimal(dot.numerator) / Decimal(dot.denominator) / (root(sum(x * x for x in a)) * root(sum(x * x for x in b))))


def slow_nearest(vectors, k):
    out = {}
    for q, v in vectors.items():
        if q % 50 == 0:
            near = sorted(((round(exact_cosine(v, w), 13), -c) for c, w in vectors.items() if c != q and len(w) == len(v)), reverse=True)
            out[q] = [(-c, s) for s, c in near[:k]]
    return out


def found(df, k=5, **how):
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, k, **how).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_neighbours(spark, monkeypatch):
    """Against cosines by exact fractions; many groups and tiles."""
    monkeypatch.setattr(neighbours, "TILE", 16)
    vectors = {r[0]: np.array(r[1], np.float32) for r in sf("embeddings") if r[0] < 300}
    vectors |= {1000 + i: vectors[3] for i in range(60)} | {2000: np.ones(3, np.float32), 2001: -np.ones(3, np.float32) * 1e-30, 2050: np.ones(3, np.float32) * 1e30}
    bad = [(3000, None), (3050, [0.0] * 64), (3001, [float("nan")] * 64), (3002, [float("inf")] + [1.0] * 63), (3003, []), (None, [1.0] * 64), (3004, [None] + [1.0] * 63)]
    data = [(i, [float(x) for x in v]) for i, v in vectors.items()] + bad
    df = spark.createDataFrame(data + data[:5], "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).withColumn("row", F.lit("clash"))
    want = slow_nearest(vectors, 5)
    for how in ({"group_bytes": 4 * 64 * 40}, {"least_rows": 50}, {}):
        got = found(df, **how)
        assert got.keys() == want.keys()
        for q, near in got.items():
            assert [c for c, _ in near] == [c for c, _ in want[q]] and [s for _, s in near] == pytest.approx([s for _, s in want[q]], abs=1e-12)
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.nearest(df.where("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_of_doubles(spark):
    """Doubles keep their last bits, and magnitudes from 1e-300 to 1e300 meet."""
    close = {0: [1.0, 0.5], 1: [1.0, 2.0000000001], 2: [1.0, 2.0], 3: [1e-50, 1e-50], 4: [-1.0, 0.0], 5: [1e300, 1e300], 6: [3e-300, 1e-300], 50: [1e-300, 2e-300]}
    df = spark.createDataFrame(list(close.items()), "vec_id long, embedding array<double>")
    got = found(df, k=7)
    for q in (0, 50):
        near = sorted(((exact_cosine(close[q], v), -i) for i, v in close.items() if i != q), reverse=True)
        assert [s for _, s in got[q]] == pytest.approx([s for s, _ in near], rel=1e-14)
    order = [c for c, _ in got[0]]
    assert order[0] == 6 and set(order[1:3]) == {3, 5} and order.index(2) < order.index(1)


def test_neighbours_recompute_few():
    """Of the pairs of a tile only those near the best are recomputed."""
    rng = np.random.default_rng(0)
    both = [pa.table({"vec_id": np.arange(i, i + n), "embedding": list(rng.normal(size=(n, 64)).astype(np.float32))}) for i, n in ((0, 50), (100, 3000))]
    heaps, (q,), held = neighbours.Heaps(50, 5), neighbours._tiles(both[0]), neighbours._tiles(both[1])
    assert 250 <= sum(neighbours.tile(q, c, heaps, 0) for c in held) < 0.05 * 50 * 3000


# ---- 8 BPE
def test_bpe(spark):
    texts = [r[1] for r in sf("documents")[:300]] + ["", None, "a" * 3000, "don't  \n\n x", "\0\x01é‍🤦🏼‍♂️", "ab" * 700, "aaab" * 300, " " * 500]
    df = docs_of(spark, texts).withColumn("ids", F.lit("clash"))
    coder = bpe.read_ranks(queries.ranks_file())
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder, special_tokens={})
    ids = bpe.encode_documents(df, queries.ranks_file(), P.PATTERN)
    back = bpe.decode_documents(ids, queries.ranks_file(), P.PATTERN).collect()
    digests = {r.doc_id: r for r in bpe.round_trip(df, queries.ranks_file(), P.PATTERN).collect()}
    assert len(back) == len(texts)
    for r in back:
        text = texts[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        d = digests[r.doc_id]
        assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(r.ids), hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.round_trip(df.where("false"), queries.ranks_file(), P.PATTERN).count() == 0


def test_bpe_long_pieces():
    """Unbroken runs of letters, marks and wide characters, and one beyond 4 MiB, against the tiktoken library."""
    rng = np.random.default_rng(5)
    coder = bpe.Coder(queries.ranks_file(), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    texts = ["".join(rng.choice(list(letters), n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ACGT", "qzjx", "中文字符測試語言", "абвгдежз", "!@#$%^&*()=", "😀😁🎉") for n in (65, 300, 20_000)]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == enc.encode_ordinary(text)
    import re

    prose = re.sub("[^a-z]", "", "".join((r[1] or "").lower() for r in sf("documents")[:400]))
    texts = [prose[:400_000], prose[7:5_000] + "ab" * 400 + prose[:3_000], "ing" * 20_001, "thein" * 5_001, ("ab" * 300 + prose[:777]) * 20]
    assert len(texts[0]) == 400_000
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == enc.encode_ordinary(text)
    long = "ab" * 2_200_000
    ids = coder.encode([long])
    assert coder.decode(ids) == [long.encode()] and ids[0][:1000].tolist() == enc.encode_ordinary(long[:8000])[:1000]


def test_bpe_keeps_frequent_pieces_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 30)
    coder = bpe.Coder(queries.ranks_file(), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    learnt, learn = [], coder._learn
    monkeypatch.setattr(coder, "_learn", lambda pieces: (learnt.extend(pieces), learn(pieces)))
    for n in range(12):
        text = "zqfrequent zqoften " * 3 + " ".join(f"zq{chr(97 + n)}{chr(97 + k)}rare" for k in range(20))
        (ids,) = coder.encode([text])
        assert ids.tolist() == enc.encode_ordinary(text) and coder.decode([ids]) == [text.encode()]
        assert len(coder.numbers) <= 30 + 25 and len(coder.uses) == len(coder.numbers) == len(coder.starts)
    assert learnt.count(b" zqfrequent") == learnt.count(b" zqoften") == 1


# ---- 9 Jaccard
def slow_shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def slow_components(texts):
    sets, n = [slow_shingles(t) for t in texts], len(texts)
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 85 * max(len(a), len(b)) and 100 * (c := len(a & b)) >= 85 * (len(a) + len(b) - c):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), find(i)) for i in range(n)]


def test_jaccard(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)  # many blocks
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 500)
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(3000)])
    passage = " ".join(rng.choice(words, 60))
    texts = ["", None, "one", "One", "a b c", "a b c d", " \t", "x " * 500]
    for k in range(6):
        base = rng.choice(words, 40 + 40 * k)
        texts += [" ".join(base), " ".join(base).upper()]
        for _ in range(40):
            copy = base.copy()
            at = rng.integers(0, len(copy), int(rng.integers(0, 1 + len(copy) // 20)))
            copy[at] = rng.choice(words, len(at))
            texts.append(" ".join(copy) + (" " + passage if rng.random() < 0.3 else ""))
    texts += [" ".join(rng.choice(words, 60)) + " " + passage for _ in range(60)]
    df = docs_of(spark, texts).withColumn("n", F.lit("clash"))
    assert rows(jaccard.near_classes(df)) == sorted(slow_components(texts), key=str)
    both = jaccard.near_classes(df.union(df.where("doc_id < 20")))
    assert both.distinct().count() == len(texts) and both.count() == len(texts) + 20
    assert jaccard.near_classes(df.where("false")).count() == 0


def test_jaccard_filters_before_sets(spark, monkeypatch):
    """Pairs that share one of four passages don't reach their sets; every linked pair does."""
    rng = np.random.default_rng(6)
    words = np.array([f"w{i}" for i in range(50_000)])
    passages = rng.choice(words, (4, 7, 30), replace=False)
    texts = [" ".join(" ".join(passages[k, at]) for k, at in enumerate((i, j, (i + j) % 7, (i + 2 * j) % 7))) for i in range(7) for j in range(7)]
    texts += [" ".join(t.split()[:-1]) for t in texts[:10]]
    seen = {}
    checked, filters = jaccard._verified, jaccard.filtered
    monkeypatch.setattr(jaccard, "filtered", lambda pairs, sets, percent: seen.setdefault("before", pairs.count()) and filters(pairs, sets, percent))
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, sets, percent: seen.setdefault("after", pairs.count()) and checked(pairs, sets, percent))
    got = rows(jaccard.near_classes(docs_of(spark, texts)))
    assert got == sorted(slow_components(texts), key=str) and sum(i != c for i, _, c in got) == 10
    print(seen)
    assert seen["before"] >= 59 and 10 <= seen["after"] < seen["before"] / 2


def test_jaccard_with_common_tokens(spark, monkeypatch):
    """One line stands in every text, so its runs are very common; they are joined in parts."""
    monkeypatch.setattr(jaccard, "COMMON", 5)
    rng = np.random.default_rng(9)
    line = " this very line of eight words stands everywhere"
    texts = [" ".join(rng.choice(list("abcdefghij"), 12)) + line for _ in range(60)] + [f"{i} {i} {i}" + line for i in range(10)]
    texts += [texts[3], texts[4] + " more", line * 30, line * 30 + " z"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_classes(docs_of(spark, texts)).collect()}
    assert got == {i: (n, c) for i, n, c in slow_components(texts)}


def test_jaccard_table(spark):
    texts = [r[1] for r in sorted(sf("documents"))]
    assert rows(queries.op9_jaccard(spark, SF)) == sorted(slow_components(texts), key=str)


def test_shingles_in_blocks(monkeypatch):
    import emberlens.llm.shingles as S

    text = ("Éa bb CCC\tdd " + "y" * 5000 + " ").encode() * 40
    whole = shingle_set(text, 4)
    monkeypatch.setattr(S, "_BLOCK", 100)
    assert np.array_equal(whole, shingle_set(text, 4)) and len(whole) == 5


# ---- 10 mixing
def slow_targets(sizes, weights, cap):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        free -= over
    return target


def slow_fit(sizes, target):
    """Places (numbers of middle words) of each document's copies: whole ones while they fit, then the longest that fits, three times, or else the next one."""
    total, starts = sum(sizes), np.concatenate([[0], np.cumsum(sizes)]).tolist()
    places = [[i * total + starts[j] + n / 2 for i in range(3) if i * total + starts[j] + n <= target] for j, n in enumerate(sizes)]
    end = max((p[-1] + n / 2 for p, n in zip(places, sizes) if p and n), default=0)
    free = [j for j, n in enumerate(sizes) if n and len(places[j]) < 3]
    following = min(((len(places[j]) * total + starts[j], sizes[j], j) for j in free), default=None)
    to, fills = end, {}
    for _ in range(3):
        fits = [(sizes[j], -starts[j], j) for j in free if to + sizes[j] <= target and j not in fills]
        if fits:
            n, _, j = max(fits)
            fills[j] = to + n / 2
            to += n
    if following and end + following[1] - target < target - to:
        fills = {following[2]: end + following[1] / 2}
    for j, place in fills.items():
        places[j].append(place)
    return [sorted(p) for p in places]


def test_mixing(spark):
    rng = np.random.default_rng(2)
    names = ["a", "b", "é", None, "", "big", "z"]
    data = [(i, " ".join(["w"] * int(rng.integers(0, 60))) if i % 50 else None, "en", names[min(6, int(rng.exponential(1.5)))] if i % 3 else "big", i) for i in range(1500)]
    df = spark.createDataFrame(data, DOCS).withColumn("size", F.lit("clash"))
    run = lambda d: mixing.placed(mixing.plan_mix(d))
    out = run(df).collect()
    sizes, taken, order = {}, {}, {}
    for r in out:
        assert r.mix_size == len((r.text or "").split()) and r.size == "clash" and 0 <= r.mix_copies <= 3 and r.mix_taken == r.mix_copies * r.mix_size
        sizes[r.source] = sizes.get(r.source, 0) + r.mix_size
        taken[r.source] = taken.get(r.source, 0) + r.mix_taken
        order.setdefault(r.source, []).append((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r))
    want = slow_targets(sizes, mixing.WEIGHTS, 3)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    for source, held in order.items():
        # the middle word of every copy against the words asked for by its time: the schedule's integral, summed numerically
        slope = mixing.SLOPES[names.index(source) % 3]
        t = np.linspace(0, 1, 100_001)
        asked = want[source] * np.concatenate([[0], np.cumsum((1 + slope * (t[1:] + t[:-1] - 1)) / 100_000)])
        held = sorted(held, key=lambda x: x[0])
        places = slow_fit([r.mix_size for _, r in held], held[0][1].mix_target)
        placed = {r.doc_id: [np.interp(x, asked, t) for x in p] for (_, r), p in zip(held, places)}
        longest = max(r.mix_size for _, r in held)
        assert abs(taken[source] - want[source]) <= longest / 2
        for _, r in held:
            got = placed.get(r.doc_id, [])
            assert r.mix_target == pytest.approx(want[source]) and r.mix_source_size == sizes[source] and r.mix_copies == len(got)
            assert not got or (r.mix_first, r.mix_last) == (pytest.approx(got[0], abs=1e-6), pytest.approx(got[-1], abs=1e-6))
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    seen = lambda rows: sorted((r.doc_id, r.mix_taken, r.mix_first, r.mix_last) for r in rows)
    assert seen(out) == seen(run(df.repartition(7)).collect())
    laid = mixing.lay_out(mixing.plan_mix(df)).select("mix_position").collect()
    assert [r[0] for r in laid] == sorted(r[0] for r in laid) and len(laid) == sum(r.mix_copies for r in out)
    assert run(df.where("false")).count() == 0
    empty = run(df.where("text IS NULL")).collect()
    assert [(r.mix_taken, r.mix_copies, r.mix_first) for r in empty] == [(0, 1, 0.0)] * 30
    twice = run(df.where("doc_id < 3").union(df.where("doc_id < 3")).withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(twice) == 6 and all(r.mix_copies <= 3 for r in twice)


def test_mixing_clashing_names(spark):
    made = ["mix_size", "MIX_POSITIONS", "mix_position", "mix_copies", "mix_taken", "mix_first", "mix_row", "mix_size_"]
    df = docs_of(spark, ["a b", "c", None]).select("*", *[F.lit(i).alias(n) for i, n in enumerate(made)])
    out = mixing.placed(mixing.plan_mix(df))
    assert len({c.lower() for c in out.columns}) == len(out.columns) == len(df.columns) + 7
    r = out.orderBy("doc_id").first()
    assert (r.mix_size, r["mix_size__"], r.mix_size_, r["MIX_POSITIONS_"], r.mix_copies_, r.mix_row_) == (2, 0, 7, 1, 3, 6)
    laid = mixing.lay_out(mixing.plan_mix(df))
    assert laid.where("mix_position_ = 2").count() == laid.count() > 0


@pytest.mark.parametrize(("folder", "share"), [("sf0.001", 0.06), ("sf0.01", 0.01)])
def test_mixing_comes_near_its_targets(spark, folder, share):
    """Sources of few, large documents too: all together off by a small share, none by more than half of a document."""
    taken, target, longest = {}, {}, {}
    source = dict(duckdb.sql(f"SELECT doc_id, source FROM '/root/testdata/{folder}/documents.parquet'").fetchall())
    for r in queries.op10_mixing(spark, f"/root/testdata/{folder}").collect():
        s = source[r.doc_id]
        taken[s], target[s], longest[s] = taken.get(s, 0) + r.taken, r.target, max(longest.get(s, 0), r.size)
    off = {s: abs(taken[s] - target[s]) for s in target}
    assert all(off[s] <= longest[s] / 2 for s in target) and sum(off.values()) <= share * sum(target.values())


# ---- registered queries
def test_every_query_is_registered():
    own = [n for n in queries.QUERIES if n not in ("pipeline", "line_dedup_all_lengths", "line_dedup_long_lines", "mixing_positions")]
    assert sorted(int(n[2:].split("_")[0]) for n in own) == list(range(1, 14))
    json.dumps(queries.ORACLES)


def test_mixing_counts_placed_copies(spark, monkeypatch):
    """op10_mixing's rows come from the laid-out run: a run that loses a copy shows."""
    whole = {r.doc_id: r for r in queries.op10_mixing(spark, SF).collect()}
    first = {r.doc_id: r.first_at for r in queries.mixing_positions(spark, SF).collect()}
    lay_out = mixing.lay_out
    monkeypatch.setattr(mixing, "lay_out", lambda plan: lay_out(plan).where("mix_position < 0.5"))
    half = {r.doc_id: r for r in queries.op10_mixing(spark, SF).collect()}
    assert whole.keys() == half.keys() == first.keys() and sum(r.taken for r in half.values()) < sum(r.taken for r in whole.values())
    assert all(half[i].taken == 0 for i, at in first.items() if at is None or at >= 0.5)
