"""The pipeline's stages, each against brute force on its own input."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from emberlens.llm import bpe, mixing
from emberlens.llm.queries import ranks_file
from emberlens.shared import materialize
from tests.llm.test_operators import slow_dedup

SF = "/root/testdata/sf0.001"


def slow_lines(rows):
    """What is left of each text: near lines of 30 or more go, and exact repeats of every non-empty line; texts with nothing left go whole."""
    rows = sorted(rows)
    gone, seen, out = slow_dedup([t for _, t in rows], 30), set(), {}
    for k, (i, t) in enumerate(rows):
        lines = t.split("\n")
        for j, x in enumerate(lines):
            if (x := x.strip(" ")) in seen:
                gone.add((k, j))
            elif x:
                seen.add(x)
        left = [x for j, x in enumerate(lines) if (k, j) not in gone]
        if len(left) == len(lines) or any(x.strip(" ") for x in left):
            out[i] = "\n".join(left)
    return out


def slow_keepers(texts, words, percent):
    sets, up = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in texts:
        for j in texts:
            a, b = sets[i], sets[j]
            if i < j and a and b and 100 * (c := len(a & b)) >= percent * (len(a) + len(b) - c):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i for i in texts if find(i) == i}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    names, stages = zip(*corpus_pipeline.STAGES)
    before = [tuple(r) for r in docs.orderBy("doc_id").collect()]

    kept = stages[0](spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([labels[i] == (i in ids) for i in labels]) > 0.9

    some = stages[1](spark, kept, SF)
    want = slow_lines([(r[0], r[1]) for r in before if r[0] in ids])
    got = {r.doc_id: r.text for r in some.collect()}
    assert got == want

    one = stages[2](spark, some, SF)
    keep = slow_keepers(got, 5, 80)
    assert {r.doc_id for r in one.collect()} == keep

    mixed = stages[3](spark, one, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= keep
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == Counter({r.doc_id: r.mix_copies for r in mixing.placed(mixing.plan_mix(one)).collect() if r.mix_copies})
    coded = stages[4](spark, materialize(mixed, "mixed"), SF).collect()
    run = sorted((p, r.doc_id) for r in mixing.plan_mix(one).collect() for p in r.mix_positions)
    assert [r.doc_id for r in sorted(coded, key=lambda r: r.run_position)] == [i for _, i in run]
    assert sorted(r.run_position for r in coded) == list(range(len(run)))
    out = Counter(tuple(r)[:4] for r in coded)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(ranks_file()), special_tokens={})
    for i, n in copies.items():
        ids = enc.encode_ordinary(got[i])
        row = (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(got[i].encode()).hexdigest())
        assert out.pop(row) == n
    assert not out


def test_run(spark):
    """The whole run is the stages one after the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "run_position"]
    rows = Counter(tuple(r) for r in out.collect())
    assert rows == Counter(tuple(r) for r in docs.collect()) and sum(rows.values()) > 50


def test_stages_on_odd_rows(spark):
    """Nulls in every column, repeated rows, ties, an empty table and clashing names."""
    odd = [(1, None, None, None, None), (None, "a text without an id that is long enough to be a line", "en", "web", 5), (2, "", "en", None, 0), (3, "twice", "en", "web", 5), (3, "twice", "en", "web", 5), (4, "\n\n", None, "web", 2)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit("clash") for n in ("quality_score", "dedup_removed", "mix_positions", "component_id", "ids", "line_no")})
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, docs.where("false"), SF)
        rows = [tuple(r) for r in out.collect()]
        assert none.count() == 0 and out.columns == none.columns, name
        if name != "bpe":
            assert out.columns == corpus_pipeline.COLUMNS
        if name == "line_dedup":  # a repeated doc_id is one document; what repeats its own line goes from both rows, a null text stays
            assert sorted((r[0] or 0, r[1] or "") for r in rows) == [(0, odd[1][1]), (1, ""), (2, ""), (3, "twice"), (3, "twice"), (4, "\n\n")]
        if name in ("ngram_jaccard", "bpe"):
            assert len(rows) == 6 and sum(r[0] == 3 for r in rows) == 2
        if name == "mix_sources":
            assert set(rows) <= set(odd)


def test_near_copies_from_eighty_percent(spark):
    """Two of a hundred words differ: 0.81 on runs of five words, 0.848 on runs of four."""
    words = [f"w{i}" for i in range(100)]
    copy = words[:30] + ["x"] + words[31:70] + ["y"] + words[71:]
    other = [f"v{i}" for i in range(100)]
    rows = [(i, " ".join(w), "en", "web", 0) for i, w in enumerate((words, copy, other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()) == [0, 2]


def test_short_clean_text_stays(spark):
    """A short clean text beside a shared line stays; what was nothing but shared lines goes."""
    shared = "This whole line is shared by several documents of the table."
    texts = [shared + "\nfirst", shared + "\nA clean short line.", shared, shared + "\n\n ", ""]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert got == {0: texts[0], 1: "A clean short line.", 4: ""}


def test_short_repeats_go(spark):
    """Against brute force: exact repeats of short lines go too, and only documents with nothing left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want = slow_lines(rows)
    assert any(t != want.get(i, t) and len(slow_dedup([t], 30)) == 0 for i, t in rows)
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()} == want
