"""Sparse dot products between a large posting table and a small query side."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import is_small

MAX_WEIGHTS = 1_000_000
MAX_QUERIES = 2048
SLICE = 4096  # postings per step: bounds the work arrays to SLICE x MAX_QUERIES


def sparse_product(postings: DataFrame, weights: DataFrame, *, id_col: str, qid: str, unit: str) -> DataFrame:
    """(qid, id, score) with score = sum over shared units of x * w.

    ``postings`` is (id, unit, x), ``weights`` (qid, unit, w).  Joining both
    makes one row per posting and query that share a unit, which is many times
    the posting table when units are common.  While the measured query side is
    small, tasks hold it as arrays and add up a whole slice of postings at
    once; otherwise the join is used.
    """
    w = weights.select(F.col(qid).alias("q"), F.col(unit).alias("u"), F.col("w").cast("double").alias("w"))
    if is_small(w, MAX_WEIGHTS) and w.select("q").distinct().limit(MAX_QUERIES + 1).count() <= MAX_QUERIES:
        parts = _in_tasks(postings, w, id_col, qid, unit)
    else:
        joined = postings.join(weights, unit)
        parts = joined.select(qid, id_col, (F.col("x") * F.col("w")).alias("score"))
    return parts.groupBy(qid, id_col).agg(F.sum("score").alias("score"))


def _in_tasks(postings: DataFrame, w: DataFrame, id_col: str, qid: str, unit: str) -> DataFrame:
    spark = postings.sparkSession
    small = w.toPandas()  # measured above
    u_codes, units = small["u"].factorize()
    q_codes, queries = small["q"].factorize()
    order = np.argsort(u_codes, kind="stable")
    starts = np.searchsorted(u_codes[order], np.arange(len(units) + 1))
    shared = spark.sparkContext.broadcast((starts, q_codes[order], small["w"].to_numpy()[order], pa.array(queries)))
    codes = spark.createDataFrame([(u, i) for i, u in enumerate(units.tolist())], f"{unit} string, _code int")
    coded = postings.join(F.broadcast(codes), unit).select(F.col(id_col), "_code", F.col("x").cast("double").alias("x"))
    id_type, q_type = dict(postings.dtypes)[id_col], dict(w.dtypes)["q"]

    def run(batches):
        first, owner, weight, names = shared.value
        n_queries = len(names)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = part.column(0).dictionary_encode()
                row = ids.indices.to_numpy(zero_copy_only=False)
                code, x = part.column(1).to_numpy(), part.column(2).to_numpy()
                lengths = first[code + 1] - first[code]
                source = np.repeat(np.arange(len(code)), lengths)
                ends = np.cumsum(lengths)
                entry = np.arange(len(source)) + np.repeat(first[code] - ends + lengths, lengths)
                sums = np.bincount(row[source] * n_queries + owner[entry], weights=x[source] * weight[entry], minlength=1)
                hit = np.nonzero(sums)[0]
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(hit % n_queries)), ids.dictionary.take(pa.array(hit // n_queries)), pa.array(sums[hit])], names=[qid, id_col, "score"]
                )

    return coded.mapInArrow(run, f"{qid} {q_type}, {id_col} {id_type}, score double")
