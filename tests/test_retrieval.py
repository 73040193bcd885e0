"""Retrieval on a three-file lake, and scores against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakequill.config import EngineConfig
from lakequill.functions.questions import profile
from lakequill.operators import hybrid as H
from lakequill.operators import product
from lakequill.operators.bm25 import bm25_scores
from lakequill.operators.chargram import chargram_cosine
from lakequill.operators.chunking import lake_chunks
from lakequill.operators.containment import contains_pairs, passages_in_texts
from lakequill.operators.dense import dense_top_k, rank_profile
from lakequill.operators.direct import direct_matches, glob_matches
from lakequill.sources.manifest import catalogue

TEXTS = {1: "the quick brown fox", 2: "the lazy dog and the fox", 3: "nothing here", 4: ""}
ASKS = {10: "fox fox dog", 11: "the quick"}


def frames(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "id int, text string")
    return docs, spark.createDataFrame(list(ASKS.items()), "q int, ask string")


def test_bm25_matches_formula_with_multiplicity(spark):
    docs, asks = frames(spark)
    got = {(r["q"], r["id"]): r["score"] for r in bm25_scores(docs, asks, id_col="id", text_col="text", qid="q", query_col="ask").collect()}
    toks = {i: [t for t in re.findall(r"[a-z0-9_./*\-]+", x) if len(t) > 1] for i, x in TEXTS.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(t for x in toks.values() for t in set(x))
    for q, ask in ASKS.items():
        for i, x in toks.items():
            want = sum(
                math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / avg))
                for t in ask.split() if t in x
            )
            assert got.get((q, i), 0.0) == pytest.approx(want)


def grams(text):
    out = Counter()
    for w in text.lower().split():
        w = f" {w} "
        for n in (3, 4, 5):
            for i in range(len(w) - n + 1):
                out[w[i : i + n]] += 1
    return out


@pytest.mark.parametrize("with_query", [False, True])
def test_chargram_cosine_matches_brute_force(spark, with_query):
    docs, asks = frames(spark)
    rows = chargram_cosine(docs, asks, id_col="id", text_col="text", qid="q", query_col="ask", fit_includes_query=with_query).collect()
    got = {(r["q"], r["id"]): r["score"] for r in rows}
    g = {i: grams(x) for i, x in TEXTS.items()}
    for q, ask in ASKS.items():
        corpus = list(g.values()) + ([grams(ask)] if with_query else [])
        df = Counter(t for x in corpus for t in x)
        idf = {t: math.log((1 + len(corpus)) / (1 + d)) + 1 for t, d in df.items()}
        vec = lambda c: {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        qv = vec(grams(ask))
        for i, x in g.items():
            dv = vec(x)
            dot = sum(w * dv.get(t, 0) for t, w in qv.items())
            assert got.get((q, i), 0.0) == pytest.approx(dot / (norm(dv) * norm(qv)) if dot else 0.0)


def test_large_query_sides_use_the_join(spark, monkeypatch):
    docs, asks = frames(spark)
    names = dict(id_col="id", text_col="text", qid="q", query_col="ask")
    small = {tuple(r)[:2]: r["score"] for r in bm25_scores(docs, asks, **names).collect()}
    monkeypatch.setattr(product, "MAX_QUERIES", 1)
    large = {tuple(r)[:2]: r["score"] for r in bm25_scores(docs, asks, **names).collect()}
    assert small.keys() == large.keys() and all(small[k] == pytest.approx(large[k]) for k in small)


def lake(spark):
    rows = [
        ("finance/Credit.csv", "Income,Limit,Rating,Balance\n14.8,3606,283,333"),
        ("images/scholarship1.png", "scholarship table"),
        ("docs/notes.txt", "Meeting notes about the AXIOM roadmap and the next milestones."),
    ]
    files = spark.createDataFrame(rows, "path string, body string")
    manifest = catalogue(files, F.col("path"), F.col("body"))
    return manifest, lake_chunks(manifest)


def ask(spark, question, **config):
    manifest, chunks = lake(spark)
    p = profile(spark.createDataFrame([("q", question, "")], "qid string, question string, answer_type string"))
    return H.retrieve(p, manifest, chunks, EngineConfig(**config)).orderBy("rank").collect()


def test_explicit_file_wins(spark):
    best = ask(spark, "What is the average balance in Credit.csv?")[0]
    assert best["relative_path"] == "finance/Credit.csv" and best["reason"].startswith("explicit") and best["score"] == 10.0


def test_topic_is_found_and_nonsense_is_empty(spark):
    assert ask(spark, "What does the meeting say about the AXIOM roadmap?")[0]["relative_path"] == "docs/notes.txt"
    assert ask(spark, "zzz qqq xxyyzz unrelated gibberish", min_relevance=1.01) == []


def test_sum_pooling_ranks_named_file_first(spark):
    manifest, chunks = lake(spark)
    p = profile(spark.createDataFrame([("q", 'Read "notes.txt" now', "")], "qid string, question string, answer_type string"), "earlier")
    assert H.retrieve_sum_pooled(p, manifest, chunks).orderBy("rank").first()["relative_path"] == "docs/notes.txt"


def test_rare_keyword(spark):
    chunks = spark.createDataFrame([(f"{c}.txt", "project " + ("novacare" if c == "a" else "other")) for c in "abcdefg"], "file_id string, text string")
    p = spark.createDataFrame([("q", ["novacare", "project"])], "qid string, keywords array<string>")
    assert [tuple(r) for r in H.rare_keyword_files(p, chunks).collect()] == [("q", "a.txt")]


def test_containment_matches_brute_force(spark):
    hay = ["one two three four", "xone twox three", "a b", "two", "three  four", "abcdefgh", "", "one\ntwo three"]
    needles = ["two three", "two", "one two three", "wo", "b", "ne two", "three  four", "cdefg", "zzz", "one", " two "]
    h = spark.createDataFrame(list(enumerate(hay)), "h int, t string")
    n = spark.createDataFrame(list(enumerate(needles)), "n int, s string")
    want = {(i, j) for i, t in enumerate(hay) for j, s in enumerate(needles) if s in t}
    got = contains_pairs(h, n, hid="h", hay_col="t", nid="n", needle_col="s", width=3)
    assert {tuple(r) for r in got.select("h", "n").collect()} == want
    got = passages_in_texts(h, n, hid="h", hay_col="t", nid="n", needle_col="s")
    assert {tuple(r) for r in got.select("h", "n").collect()} == want


def test_direct_match_precedence(spark):
    files = spark.createDataFrame([("a/report.csv",), ("a/my_report.csv",), ("pics/1.png",), ("pics/2.png",), ("b/summary.md",)], "relative_path string")
    p = spark.createDataFrame(
        [("q", "see summary", ["report.csv"], ["pics/*"])], "qid string, question string, hints array<string>, patterns array<string>"
    )
    got = {r["path"]: r["reason"] for r in direct_matches(p, files).collect()}
    assert got == {
        "a/report.csv": "explicit_file", "a/my_report.csv": "explicit_text", "pics/1.png": "explicit_pattern",
        "pics/2.png": "explicit_pattern", "b/summary.md": "filename_in_question",
    }


def test_glob_without_literal_matches_all(spark):
    files = spark.createDataFrame([("a",), ("b/c",)], "p string").withColumn("k", F.col("p"))
    g = spark.createDataFrame([(1, "*"), (2, "b/?")], "n int, g string")
    got = glob_matches(g, files, nid="n", pattern_col="g", path="p", path_key="k", any_folder=False)
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b/c", 1), ("b/c", 2)}


def test_dense_blocks_agree_and_rank_profile_is_exact(spark):
    rng = np.random.default_rng(3)
    vecs, asks = rng.normal(size=(40, 6)), rng.normal(size=(5, 6))
    v = spark.createDataFrame([(i, i // 4, x.tolist()) for i, x in enumerate(vecs)], "chunk_id int, file int, v array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asks)], "qid int, qv array<double>")
    names = dict(id_col="chunk_id", vec_col="v", qid="qid", qvec_col="qv", k=7)
    few = {tuple(r) for r in dense_top_k(v, q, **names).collect()}
    many = {tuple(r) for r in dense_top_k(v, q, query_block=2, **names).collect()}
    assert few == many and len(few) == 35
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(unit(vecs) @ unit(asks).T, 6)
    gold = {0: {2}, 1: {5, 9}, 2: {0}, 3: {7}, 4: {3}}
    e = spark.createDataFrame([(i, f) for i, fs in gold.items() for f in fs], "qid int, file int")
    for block in (2, 100):
        chunk_rank, file_rank, _, top_files = rank_profile(v, q, e, vec_col="v", qvec_col="qv", k=3, query_block=block)
        c, f = dict(chunk_rank.collect()), dict(file_rank.collect())
        for i, fs in gold.items():
            order = sorted(range(40), key=lambda j: -s[j, i])
            assert c[i] == next(r for r, j in enumerate(order, 1) if j // 4 in fs)
            peaks = {g: s[g * 4 : g * 4 + 4, i].max() for g in range(10)}
            files = sorted(peaks, key=lambda g: -peaks[g])
            assert f[i] == next(r for r, g in enumerate(files, 1) if g in fs)
            assert [r["file"] for r in top_files.filter(F.col("qid") == i).orderBy("rank").collect()] == files[:3]
