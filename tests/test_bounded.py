"""Bounded passes against complete score tables."""

import random

import pytest
from pyspark.sql import functions as F

from lakequill.operators import bounded as B
from lakequill.operators import metrics as E
from lakequill.operators.bm25 import bm25_scores
from lakequill.operators.chargram import chargram_cosine
from lakequill.operators.ranking import top_k

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron sigma upsilon omega".split()


def _texts(spark, n=300):
    rng = random.Random(5)
    rows = [(f"f{rng.randrange(12) if i % 3 else 0}", f"c{i:03}", " ".join(rng.choices(WORDS, k=rng.choice([0, 1, 5, 30])))) for i in range(n)]
    asks = [(i, " ".join(rng.choices(WORDS, k=3))) for i in range(7)] + [(7, "nothing such"), (8, "")]
    return spark.createDataFrame(rows, "file string, id string, text string"), spark.createDataFrame(asks, "q int, ask string")


def _small(monkeypatch):
    """Many blocks of texts and questions, files in several parts."""
    for name, value in (("BLOCK", 4), ("PART", 10), ("MAX_QUERIES", 3), ("DENSE", 1)):
        monkeypatch.setattr(B, name, value)


def _scores(texts, asks, signal):
    names = dict(id_col="id", text_col="text", qid="q", query_col="ask")
    found = bm25_scores(texts, asks, **names) if signal == B.TERMS else chargram_cosine(texts, asks, fit_includes_query=signal == B.GRAMS_QUERY, **names)
    return found.withColumn("score", F.round("score", 6)).filter("score > 0")


def _index(texts, asks, signal):
    return B.index(texts, asks, signals=[signal], id_col="id", file_col="file", text_col="text", qid="q", query_col="ask")


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("signal", [B.TERMS, B.GRAMS, B.GRAMS_QUERY])
def test_best_texts(spark, monkeypatch, signal, small):
    if small:
        _small(monkeypatch)
    texts, asks = _texts(spark)
    order = [F.desc("score"), F.asc("id")]
    want = top_k(_scores(texts, asks, signal), ["q"], order, 5).select("q", "id", "score", "rank")
    built = _index(texts, asks, signal)
    assert len(built) == (1 if not small else len(built)) and (not small or len(built) > 1)
    got = top_k(B.best_texts(built, 5).select("q", "id", F.round("v", 6).alias("score")), ["q"], order, 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("small", [False, True])
def test_ranks_of_expected_files(spark, monkeypatch, small):
    if small:
        _small(monkeypatch)
    texts, asks = _texts(spark)
    expected = spark.createDataFrame([(0, "f3"), (0, "f0"), (1, "f1"), (2, "f5"), (3, "none"), (7, "f2")], "q int, file string").withColumnRenamed("q", "qid")
    scored = _scores(texts, asks, B.TERMS).join(texts.select("id", "file"), "id").withColumnRenamed("q", "qid")
    files = scored.groupBy("qid", "file").agg(F.max("score").alias("score"))
    text_ranks = {r[0]: r[1] for r in E.first_relevant_rank(scored, expected, ["qid"], "id", "file", "rank").collect()}
    file_ranks = {r[0]: r[1] for r in E.first_relevant_rank(files, expected, ["qid"], "file", "file", "rank").collect()}
    built = B.index(texts, asks.withColumnRenamed("q", "qid"), signals=[B.TERMS], id_col="id", file_col="file", text_col="text", qid="qid", query_col="ask")
    got = E.evaluate({"m": built}, expected).collect()
    assert {r.qid: r.first_chunk_rank for r in got if r.first_chunk_rank} == text_ranks
    assert {r.qid: r.first_file_rank for r in got if r.first_file_rank} == file_ranks
    assert {0, 1, 2, 3, 7} == {r.qid for r in got}


def test_bounds_skip_blocks_but_lose_nothing(spark, monkeypatch):
    seen = []
    scores = B.Block.scores
    monkeypatch.setattr(B.Block, "scores", lambda self, weights, active: seen.append(len(active)) or scores(self, weights, active))
    monkeypatch.setattr(B, "BLOCK", 8)
    import numpy as np
    import pyarrow as pa

    weights = {"s": B.Weights(np.array([0, 1, 2]), np.array([0, 1]), np.array([1.0, 1.0]), None, 2)}
    rows = []
    for i in range(64):
        rows.append({"id": i, "file": i, "part": 0, "whole": True, "s": [{"code": i % 2, "x": 10.0 if i < 8 else 1.0}], "s_norm": 1.0})
    kind = pa.schema([("id", pa.int64()), ("file", pa.int64()), ("part", pa.int32()), ("whole", pa.bool_()), ("s", pa.list_(pa.struct([("code", pa.int32()), ("x", pa.float64())]))), ("s_norm", pa.float64())])
    batch = pa.RecordBatch.from_pylist(rows, schema=kind)
    names = ["kind", "q", "id", "file", "v", "b", "n", "score"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]

    class Shared:
        value = weights

    top = lambda: [B.Top(2, 1, "id", 1)]
    # one text per question is pruned to after more than four were seen
    out = [r for b in B._pass(Shared, top, B.Mixer([1.0], None, 6), names, types)([batch]) for r in b.to_pylist()]
    assert {(r["q"], r["id"], r["score"]) for r in out} == {(0, 0, 10.0), (1, 1, 10.0)}
    assert len(seen) < 8


def test_empty_tables(spark):
    texts, asks = _texts(spark)
    for t, a in ((texts.limit(0), asks), (texts, asks.limit(0))):
        for signal in (B.TERMS, B.GRAMS, B.GRAMS_QUERY):
            assert B.best_texts(_index(t, a, signal), 3).count() == 0
