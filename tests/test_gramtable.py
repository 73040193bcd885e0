"""Grams by one table for all tasks, texts as packed rows that stay where they are."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakequill.fixed_values import TOKEN_PATTERN
from lakequill.functions.text import BLANK
from lakequill.operators import bounded as B
from lakequill.operators import gramrows as G

TEXTS = ["ab abc  abc", "", "a", "straße 日本語の文 abcabc", "x😀😀y　😀😀 é", "abc " * 50, "日 本語a.b* - c/d_1\x1c2龥龥"]


def _split(text):
    return [w for w in re.split(BLANK.replace("\\s", " \\t\\n\\x0b\\f\\r") + "+", text) if w]


def _grams(text):
    words = [f" {w} " for w in _split(text)]
    return Counter(w[i : i + n] for w in words for n in (3, 4, 5) for i in range(len(w) - n + 1))


def test_words_and_terms_are_found_in_bytes():
    for texts in (TEXTS, [], [""]):
        words, text = G.blank_words(pa.array(texts, pa.string()))
        assert [*zip(text.tolist(), words.to_pylist())] == [(i, w) for i, t in enumerate(texts) for w in _split(t)]
        terms, text = G.index_terms(pa.array(texts, pa.string()))
        assert [*zip(text.tolist(), terms.to_pylist())] == [(i, w) for i, t in enumerate(texts) for w in re.findall(TOKEN_PATTERN, t)]


def test_packed_codes_come_back():
    rng = np.random.default_rng(5)
    for texts in (0, 1, 7):
        rows = [np.sort(rng.choice(70_000, rng.integers(0, 9), replace=False)) for _ in range(texts)]
        text, code = np.repeat(np.arange(texts), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, int)]).astype(int)
        count = rng.choice([1, 1, 2, 200, 40_000], len(code))
        packed = G.pack(texts, text, code, count)
        assert len(packed) == texts and [x.tolist() for x in G.unpack(packed)] == [text.tolist(), code.tolist(), count.tolist()]


@pytest.mark.parametrize("gathered", [10, 1_000_000])
def test_table_counts_texts(spark, monkeypatch, gathered):
    monkeypatch.setattr(G, "GATHERED", gathered)
    monkeypatch.setattr(G, "PIECE", 20)
    rows = G.gram_table(spark.createDataFrame([(t,) for t in TEXTS * 3], "t string"), "t").collect()
    letter = lambda x, shift: x >> shift & (1 << 21) - 1
    named = {"".join(map(chr, (letter(r.hi, 42), letter(r.hi, 21), letter(r.hi, 0)))) + "".join(chr(c - 1) for c in (letter(r.lo, 21), letter(r.lo, 0)) if c): r.df for r in rows}
    assert len(named) == len(rows) and named == Counter(g for t in TEXTS * 3 for g in _grams(t))
    table = G.GramTable(*(np.array([r[c] for r in rows]) for c in ("hi", "lo", "df")))
    assert table.df[table.found(["abc", " abc "])].tolist() == [named["abc"], named[" abc "]] and table.found(["zzz"]).tolist() == [-1]


def _sums(spark, signal, texts, asks):
    out = {}
    for ix in B.index(texts, asks, signals=[signal], id_col="id", file_col="file", text_col="text", qid="q", query_col="ask", bonus=[F.lit(0.25)]):
        found = ix.scan(lambda n=len(ix.names), hints=ix.hints: [B.Sums(n, 3, hints)], spark.createDataFrame([(1, "f1")], "q int, label string"))
        for r in found.groupBy("q", "file").agg(F.sum("score").alias("s"), F.sum("n").alias("n")).collect():
            out[r.q, r.file] = (round(r.s, 5), r.n)
    return out


@pytest.mark.parametrize("signal", [B.GRAMS, B.GRAMS_QUERY, B.TERMS])
def test_files_in_several_partitions_have_whole_sums(spark, monkeypatch, signal):
    rows = [(i, f"f{i % 3}", f"{w} word{i % 4} and abc{i % 2}") for i, w in enumerate(["table", "chair", "lamp", "tables", "a chair", "é"] * 6)]
    asks = spark.createDataFrame([(1, "tables word1"), (2, "abc1 lamp"), (3, "none of it")], "q int, ask string")
    one = _sums(spark, signal, spark.createDataFrame(rows, "id int, file string, text string").coalesce(1), asks)
    many = spark.createDataFrame(rows, "id int, file string, text string").repartition(5)
    assert _sums(spark, signal, many, asks) == one and len(one) >= 6
    monkeypatch.setattr(B, "SPREAD", 0)
    monkeypatch.setattr(B, "PAIR", 1)
    assert _sums(spark, signal, many.repartition(2), asks) == one
    monkeypatch.setattr(B, "PAIR", 1 << 30)
    monkeypatch.setattr(G, "MAX_GRAMS", 1)  # by blocks
    assert _sums(spark, signal, many, asks) == one


def test_passes_leave_texts_where_they_are(spark):
    texts = spark.createDataFrame([(i, f"f{i}", "some words here") for i in range(40)], "id int, file string, text string")
    asks = spark.createDataFrame([(1, "words")], "q int, ask string")
    (ix,) = B.index(texts, asks, signals=[B.GRAMS], id_col="id", file_col="file", text_col="text", qid="q", query_col="ask")
    found = ix.scan(lambda: [B.Wanted(1, 1)], spark.createDataFrame([(1, "f1")], "q int, label string"))
    assert "hashpartitioning(file" not in found._jdf.queryExecution().executedPlan().toString()
    assert dict(ix.texts.dtypes)["grams"] == "binary"  # not an object for each gram
    assert [r.file for r in found.collect()] == ["f1"]


def test_rows_of_one_id_in_several_partitions_count_once(spark):
    texts = spark.createDataFrame([(i % 4, f"word{i % 4} here") for i in range(16)], "id int, text string").repartition(6)
    asks = spark.createDataFrame([(1, "word1 word2")], "q int, ask string")
    built = B.index(texts, asks, signals=[B.GRAMS], id_col="id", text_col="text", qid="q", query_col="ask")
    assert sorted(r.id for r in B.best_texts(built, 4).collect()) == [0, 1, 2, 3]
