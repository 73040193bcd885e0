"""Character n-gram TF-IDF (3 to 5 letters inside space-padded words) and its cosine.

Smooth idf, no sublinear tf, L2 norm.  The corpus may or may not include the
query when the idf is fitted; both variants exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import rows_of
from ..functions.text import BLANK
from ..scale import broadcast_if_small, settle
from .bm25 import run_lengths
from .product import sparse_product


def word_grams(words: DataFrame, keep: list[str], word: str) -> DataFrame:
    """(keep, gram): all grams of three to five letters of space-padded words.

    A word shorter than a size has no gram of that size.  Positions are
    exploded first and the three substrings taken per position, so everything
    stays in generated code; lambdas over arrays are several times slower.
    """
    w, size, i = F.col(word), F.length(word), F.col("_i")
    at = rows_of(words, [*keep, word], F.sequence(F.lit(1), size - 2), "_i")
    cuts = [F.substring(w, i, F.lit(3))] + [F.when(i <= size - n + 1, F.substring(w, i, F.lit(n))) for n in (4, 5)]
    return rows_of(at, keep, F.array(*cuts), "gram")


def gram_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, gram, tf).

    Distinct words are counted inside the row, the much smaller word table is
    clustered by id, and grams are then counted without another shuffle.
    """
    parts = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), f"{BLANK}+")
    runs = run_lengths(F.filter(parts, lambda w: w != ""), "word", "n")
    # A stated number of partitions keeps the gram work spread: adaptive execution
    # would merge small word partitions just before they grow fifteen-fold.
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = docs.select(id_col, F.inline_outer(runs)).filter(F.col("word").isNotNull()).repartition(spread, id_col)
    padded = counted.select(id_col, "n", F.concat(F.lit(" "), F.col("word"), F.lit(" ")).alias("_word"))
    return (
        word_grams(padded, [id_col, "n"], "_word")
        .groupBy(id_col, "gram")
        .agg(F.sum("n").alias("tf"))
    )


def chargram_cosine(
    docs: DataFrame,
    queries: DataFrame,
    *,
    id_col: str,
    text_col: str,
    qid: str,
    query_col: str,
    fit_includes_query: bool = False,
) -> DataFrame:
    """(qid, id, score) for every text that shares a gram with the query."""
    # Grams of one text stay together, so that products of a text are added up in one step.
    grams = settle(gram_counts(docs, id_col, text_col).sortWithinPartitions(id_col))
    n = docs.agg(F.count("*").alias("n")).scalar()
    freq = grams.groupBy("gram").agg(F.count("*").alias("df"))
    wanted = settle(gram_counts(queries, qid, query_col))
    if fit_includes_query:
        return _with_query_in_corpus(grams, freq, wanted, n, id_col, qid)
    idf = freq.select("gram", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    idf = settle(idf)
    weighted = grams.join(broadcast_if_small(idf), "gram").select(id_col, "gram", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # A query gram that the corpus never saw has no weight.
    asked = wanted.join(idf, "gram").select(qid, "gram", "idf", (F.col("tf") * F.col("idf")).alias("qw"))
    asked_norm = asked.groupBy(qid).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    # The text's idf is folded into the query weight, so the product reads plain counts in their stored order.
    asked = settle(asked.join(asked_norm, qid).select(qid, "gram", (F.col("qw") / F.col("qnorm") * F.col("idf")).alias("w")))
    dots = sparse_product(grams.select(id_col, "gram", F.col("tf").alias("x")), asked, id_col=id_col, qid=qid, unit="gram")
    return dots.join(norms, id_col).select(qid, id_col, (F.col("score") / F.col("norm")).alias("score"))


def _with_query_in_corpus(grams: DataFrame, freq: DataFrame, wanted: DataFrame, n: Column, id_col: str, qid: str) -> DataFrame:
    """Each query is its own last document: N + 1, and df + 1 for the grams it holds.

    Per query only the idf of its own grams differs, so a text norm is the
    shared norm plus a correction over the shared grams; nothing is refitted.
    """
    freq = settle(freq)
    base = F.log((2 + n) / (1 + F.col("df"))) + 1
    raised = F.log((2 + n) / (2 + F.coalesce(F.col("df"), F.lit(0)))) + 1
    plain = grams.join(broadcast_if_small(freq), "gram")
    norms = plain.groupBy(id_col).agg(F.sum((F.col("tf") * base) * (F.col("tf") * base)).alias("_base"))
    asked = wanted.withColumnRenamed("tf", "qtf").join(freq, "gram", "left").select(
        qid, "gram", "qtf", raised.alias("idf_q"), F.coalesce(base, F.lit(0.0)).alias("idf_0")
    )
    asked_norm = asked.groupBy(qid).agg(F.sqrt(F.sum((F.col("qtf") * F.col("idf_q")) ** 2)).alias("qnorm"))
    asked = asked.join(asked_norm, qid)
    high, low = F.col("idf_q"), F.col("idf_0")
    asked = settle(asked.select(qid, "gram", (high * high * F.col("qtf") / F.col("qnorm")).alias("w"), (high * high - low * low).alias("shift")))
    names = dict(id_col=id_col, qid=qid, unit="gram")
    dots = sparse_product(grams.select(id_col, "gram", F.col("tf").alias("x")), asked.select(qid, "gram", "w"), **names)
    shifts = sparse_product(
        grams.select(id_col, "gram", (F.col("tf") * F.col("tf")).alias("x")), asked.select(qid, "gram", F.col("shift").alias("w")), **names
    )
    shared = dots.withColumnRenamed("score", "_dot").join(shifts.withColumnRenamed("score", "_shift"), [qid, id_col], "left")
    norm = F.sqrt(F.col("_base") + F.coalesce("_shift", F.lit(0.0)))
    return shared.join(norms, id_col).select(qid, id_col, (F.col("_dot") / norm).alias("score"))
