"""Hard negatives against brute force over Python integers, and their defined results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakequill.llm.negatives import Packed, mine_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def _brute(rows, asks, k=5):
    kept = {}
    for ident, vector, label in rows:
        if None in (ident, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if any(abs(x * 256) >= math.sqrt(2.0**62 / len(vector)) for x in vector):
            continue
        one = (str(label), vector)
        kept[ident] = min(kept.get(ident, one), one)
    whole = {i: (lab, [math.floor(256 * x) for x in v]) for i, (lab, v) in kept.items()}
    out = []
    for a in (i for i in whole if asks(i)):
        label, v = whole[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, lab == label) for i, (lab, w) in whole.items() if i != a and len(w) == len(v))
        for p, pos in [(-s, i) for s, i, same in scored if same][:k]:
            hard = [(-s, i) for s, i, same in scored if not same and 80 * p <= -100 * s <= 100 * p][:k]
            out += [(a, pos, n, i, p, s) for n, (s, i) in enumerate(hard, 1)]
    return sorted(out)


def _rows(seed, n=200, dims=8, size=1.0):
    rng = random.Random(seed)
    grid = [0.0, 0.25, 0.5, -0.25, 0.75]  # coarse values: many ties
    return [(i, [size * (rng.choice(grid) if i % 2 else rng.gauss(0.2, 0.4)) for _ in range(dims)], rng.randrange(3)) for i in range(n)]


ODD = [(900, None, 1), (901, [0.0] * 8, 1), (902, [NAN] + [1.0] * 7, 1), (903, [-INF] + [1.0] * 7, 1), (904, [], 1), (905, [None] + [1.0] * 7, 1), (None, [1.0] * 8, 1),
       (906, [1.0] * 8, None), (907, [1.0, 2.0], 1), (908, [1.0, 1.0], 2), (908, [1.0, 1.0], 2), (910, [9.0, 1.0], 2), (910, [9.0, 1.0], 1), (0, [9.9] * 8, 2), (911, [1e300] * 8, 1), (914, [], 2)]


@pytest.mark.parametrize("cell_rows", [16_384, 23])
@pytest.mark.parametrize("size", [1.0, 300.0, 1e6])
def test_brute_force(spark, cell_rows, size):
    rows = _rows(1, size=size) + ODD
    got = mine_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 7 == 0, cell_rows=cell_rows).collect()
    assert sorted(map(tuple, got)) == _brute(rows, lambda i: i % 7 == 0)
    assert len(got) > 200


def test_packed_is_exact():
    rng = np.random.default_rng(3)
    for most in (1, 200, 2**20, 2**28):  # fields of 32, 64 and 128 bits
        values = rng.integers(-most, most + 1, (40, 16))
        anchor = [int(x) for x in rng.integers(-most, most + 1, 16)]
        assert Packed(values).scores(anchor).tolist() == [sum(int(x) * y for x, y in zip(row, anchor)) for row in values]


def test_negative_and_zero_scores(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [-0.9, 0.0], 1), (7, [0.0, 1.0], 1), (8, [0.0, 2.0], 1), (9, [0.0, 5.0], 2), (14, [0.0, 0.0], 2)]
    got = mine_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 7 == 0).collect()
    assert sorted(map(tuple, got)) == _brute(rows, lambda i: i % 7 == 0)


def test_clashing_names_and_empty_table(spark):
    rows = spark.createDataFrame(_rows(2, 60), SCHEMA).withColumns({"id": F.lit("x"), "cell": F.lit(1), "kind": F.lit(2), "anchor_id": F.lit(None), "rank": F.lit(0)})
    got = mine_negatives(rows, F.col("vec_id") % 7 == 0)
    assert sorted(map(tuple, got.collect())) == _brute(_rows(2, 60), lambda i: i % 7 == 0)
    assert mine_negatives(rows.limit(0), F.col("vec_id") % 7 == 0).count() == 0
