"""The queries of this folder on the given tables, and the pipeline stage by stage."""

import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from lakequill.llm import bpe
from lakequill.llm.queries import QUERIES, SQL
from tools.check import TABLES, digest


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    frame = QUERIES[name](spark, data)
    cursor = con.execute(SQL[name])
    want = ([d[0] for d in cursor.description], cursor.fetchall())
    assert sorted(frame.columns) == sorted(want[0])
    assert digest((frame.columns, [tuple(r) for r in frame.collect()]))[2] == digest(want)[2]


def test_all_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, data, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append([r.asDict() for r in docs.collect()])
        if k < 4:
            assert docs.columns == columns
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    quality, lines, near, mixed, coded = kept
    bad = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").filter("quality = 0").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1").collect()}
    left = {r["doc_id"] for r in quality}
    assert len(left & bad) <= 0.05 * len(bad) and len(good - left) <= 0.05 * len(good)
    assert {r["doc_id"] for r in lines} == left and all(r["n_chars"] == len(r["text"]) for r in lines)
    assert all(set((r["text"] or "").split("\n")) <= set(start[r["doc_id"]].split("\n")) for r in lines)
    assert len({r["text"] for r in near}) == len(near) and {r["doc_id"] for r in near} <= left
    words = lambda t: len((t or "").encode().split())
    assert abs(sum(words(r["text"]) for r in mixed) - 1.5 * sum(words(r["text"]) for r in near)) <= 20
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)), special_tokens={})
    want = []
    for r in mixed:
        ids = np.array(plain.encode_ordinary(r["text"] or ""), "<u4")
        want.append((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(want) == sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in coded)
    assert corpus_pipeline.run(spark, data).count() == len(coded)
