"""Texts by how many words of a question they hold, against plain Python."""

import random

import pytest

from lakequill.operators import overlap as O


@pytest.mark.parametrize("blocks", [1, 7])
def test_overlap_equals_counting(spark, monkeypatch, blocks):
    monkeypatch.setattr(O, "FEW_LETTERS", 1 << 30)
    monkeypatch.setattr(O, "LETTERS", 1 << 30 if blocks == 1 else 200)
    monkeypatch.setattr(O, "CELLS", 64)
    pick = random.Random(3)
    vocabulary = ["a", "an", "band", "handle", "cc", "x", "landing", "中文", "dan"]
    texts = [(n % 60 if n else None, pick.sample(vocabulary, pick.randint(0, 4))) for n in range(90)]  # ids repeat, one is null
    asked = [(q, w) for q in [1, 2, None] for w in pick.sample(["a", "an", "and", "中", "cc", "zz"], 4)] + [(1, "a"), (4, "zz")]
    words = {}
    for i, w in texts:
        words.setdefault(i, set()).update(w)
    want = set()
    for q in {q for q, _ in asked}:
        scores = {i: sum(any(t in w for w in held) for p, t in asked if p == q) for i, held in words.items()}
        best = sorted((i for i in scores if scores[i]), key=lambda i: (-scores[i], i is not None, i or 0))[:5]
        want |= {(q, i, scores[i], r + 1) for r, i in enumerate(best)}
    got = O.overlap_top_k(spark.createDataFrame(texts, "id long, words array<string>"), spark.createDataFrame(asked, "qid int, token string"), id_col="id", words_col="words", qid="qid", token="token", k=5)
    assert {tuple(r) for r in got.collect()} == want


def test_no_row_per_text_and_question(spark, tmp_path):
    """A word that every text holds made a row per text and question; a block hands on k of them."""
    dealt = spark.createDataFrame([(i, ["hay", f"w{i}"], 0) for i in range(3000)], "id long, words array<string>, _block int")
    held = spark.createDataFrame([(0, "hay")], "_block int, word string")
    weights = spark.createDataFrame([(q, "a", 1) for q in range(3)], "qid int, token string, n long")
    inside = spark.createDataFrame([("hay", "a")], "word string, token string")
    assert O._best(dealt, held, inside, weights, 8).count() == 24
