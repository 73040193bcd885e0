"""Percentiles with outliers, ties and hot keys; nearest vectors with equal scores."""

import numpy as np
from pyspark.sql import functions as F

from lakequill.operators.dense import dense_top_k
from lakequill.operators.ranking import rank_complete
from lakequill.operators.scans import percentiles


def test_percentiles_with_outlier_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in rng.standard_normal(20_000)] + [("hot", 1e12), ("hot", None)] + [("ties", 2.0)] * 9000 + [("ties", 3.0)] * 3 + [("one", 7.0)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(6)
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p999": 0.999, "p100": 1.0}
    got = {r["k"]: r for r in percentiles(frame, ["k"], "v", wanted).collect()}
    for k in ("hot", "ties", "one"):
        values = [v for key, v in rows if key == k and v is not None]
        for name, f in wanted.items():
            assert np.isclose(got[k][name], np.quantile(values, f), rtol=1e-12, atol=0)


def test_dense_top_k_with_equal_vectors(spark):
    frame = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(200)] + [(500, [0.0, 1.0])], "id long, v array<double>").repartition(3)
    found = dense_top_k(frame, frame.filter("id = 7").select(F.col("id").alias("q"), F.col("v").alias("w")), id_col="id", vec_col="v", qid="q", qvec_col="w", k=4)
    assert [r["id"] for r in found.orderBy("rank").collect()] == [0, 1, 2, 3]


def test_ranks_of_complete_sets_are_exact(spark):
    frame = spark.range(5000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("score"), "id")
    ranked = rank_complete(frame, ["k"], [F.desc("score"), F.asc("id")]).collect()
    for k in range(3):
        mine = sorted((r for r in ranked if r["k"] == k), key=lambda r: (-r["score"], r["id"]))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
