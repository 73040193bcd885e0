"""Okapi BM25 over any (id, text) table.

Term counting is row-local (sort the tokens of one text, measure the runs), so
building postings needs no shuffle.  Query terms count with multiplicity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import BM25_B, BM25_K1
from ..functions.arrays import let, rows_of
from ..functions.text import tokens
from ..scale import broadcast_if_small, settle
from .product import sparse_product

_ALL = ""  # pseudo term that every text carries once; it yields N and the total length


def run_lengths(array: Column, value: str, count: str) -> Column:
    """Distinct values of an array with their counts, within the row."""

    def runs(ordered):
        size = F.size(ordered)
        opens = F.filter(
            F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))),
            lambda i: (i < size) & ((i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))),
        )
        return let(
            opens,
            lambda starts: F.transform(
                starts,
                lambda start, j: F.struct(
                    F.get(ordered, start).alias(value), (F.coalesce(F.get(starts, j + 1), size) - start).alias(count)
                ),
            ),
        )

    return let(F.sort_array(array), runs)


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dl, term, tf); each text also yields one row for the pseudo term."""
    counted = docs.select(id_col, run_lengths(tokens(F.col(text_col)), "term", "tf").alias("_terms"))
    marked = F.concat(F.array(F.struct(F.lit(_ALL).alias("term"), F.lit(1).alias("tf"))), F.col("_terms"))
    length = F.aggregate("_terms", F.lit(0), lambda total, t: total + t["tf"])
    return counted.select(id_col, length.alias("dl"), marked.alias("_marked")).select(id_col, "dl", F.inline_outer("_marked"))


def query_terms(queries: DataFrame, qid: str, text_col: str) -> DataFrame:
    """(qid, term, qtf): the multiplicity of a term in the query is kept."""
    return (
        rows_of(queries, [qid], tokens(F.col(text_col)), "term")
        .groupBy(qid, "term")
        .agg(F.count("*").alias("qtf"))
    )


def document_frequencies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, df, cf) over the whole corpus."""
    return (
        term_counts(docs, id_col, text_col)
        .filter(F.col("term") != _ALL)
        .groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    )


def bm25_scores(
    docs: DataFrame,
    queries: DataFrame,
    *,
    id_col: str,
    text_col: str,
    qid: str,
    query_col: str,
    k1: float = BM25_K1,
    b: float = BM25_B,
) -> DataFrame:
    """(qid, id, score) for every text that shares a term with the query."""
    wanted = query_terms(queries, qid, query_col)
    vocabulary = wanted.select("term").union(docs.sparkSession.range(1).select(F.lit(_ALL).alias("term"))).distinct()
    postings = settle(term_counts(docs, id_col, text_col).join(broadcast_if_small(vocabulary), "term"))
    return _score(postings, wanted, id_col, qid, k1, b)


def _score(postings: DataFrame, wanted: DataFrame, id_col: str, qid: str, k1: float, b: float) -> DataFrame:
    totals = postings.filter(F.col("term") == _ALL).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    freq = postings.filter(F.col("term") != _ALL).groupBy("term").agg(F.count("*").alias("df"))
    # One-row totals enter as scalar subqueries; weights stay as small as the query side.
    n, avgdl = totals.select("n").scalar(), totals.select("avgdl").scalar()
    weights = wanted.join(freq, "term").select(
        qid, "term", (F.col("qtf") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (k1 + 1)).alias("w")
    )
    length = F.greatest(F.col("dl"), F.lit(1)) / F.greatest(avgdl, F.lit(1e-6))
    saturation = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * length))
    return sparse_product(postings.select(id_col, "term", saturation.alias("x")), settle(weights), id_col=id_col, qid=qid, unit="term")
