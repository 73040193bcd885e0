"""Grams counted by blocks of texts against plain counting."""

import math
from collections import Counter

from pyspark.sql import functions as F

from lakequill.operators import gramrows as G

TEXTS = ["ab abc  abc", "", "a", "Straße 日本語の文 abcabc", "x😀😀y 😀😀", "abc " * 50] * 6


def _grams(text):
    words = [f" {w} " for w in text.lower().split()]
    return Counter(w[i : i + n] for w in words for n in (3, 4, 5) for i in range(len(w) - n + 1))


def test_blocks_hold_each_gram_once_and_texts_get_their_norm(spark, monkeypatch):
    monkeypatch.setattr(G, "FEW_LETTERS", 400)
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "tid long, text string")
    blocks = G.worded_blocks(texts, "tid", "text", sum(map(len, TEXTS)))
    seen = G.block_grams(blocks)
    df = Counter(g for t in TEXTS for g in _grams(t))
    rows = seen.collect()
    assert {r["gram"]: r["df"] for r in rows} == df
    assert len({r["_block"] for r in rows}) > 1
    assert len(rows) == len({(r["_block"], r["gram"]) for r in rows}) < sum(len(_grams(t)) for t in TEXTS)  # not a row per text and gram
    rated = seen.select("_block", "number", (F.lit(1.0) / F.col("df")).alias("idf"), F.when(F.col("gram") == "abc", 7).alias("code"))
    got = G.with_grams(blocks, rated, "g").collect()
    assert sorted(r["tid"] for r in got) == list(range(len(TEXTS)))
    for r in got:
        want = _grams(TEXTS[r["tid"]])
        assert [tuple(x) for x in r["g"]] == ([(7, want["abc"])] if want["abc"] else [])
        assert r["_square"] is None if not want else math.isclose(r["_square"], sum((n / df[g]) ** 2 for g, n in want.items()))
