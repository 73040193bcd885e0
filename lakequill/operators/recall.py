"""Recall of retrieved files against expected sources, which may be paths, base names or globs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import K_VALUES
from ..functions.paths import basename, source_key
from ..scale import settle
from .direct import glob_matches


def expand_expected(expected: DataFrame, files: DataFrame) -> DataFrame:
    """(qid, path) of expected sources (qid, source) among ``files`` (path).

    A glob (with ``*``) stands for every path it matches, in any folder, maybe
    none.  Anything else is the path of the same key, else of the same base
    name (of several, the largest path), else the source itself, so that recall
    counts the miss.
    """
    wanted = expected.select("qid", "source", source_key(F.col("source")).alias("_t")).filter("_t <> ''")
    keyed = files.select("path", source_key(F.col("path")).alias("_k")).groupBy("_k").agg(F.max("path").alias("path"))
    is_glob = F.contains("_t", F.lit("*"))
    globs = wanted.filter(is_glob).select("qid", "_t").distinct()
    patterns = settle(globs.select("_t").distinct().withColumn("_pattern", F.col("_t")))
    matched = glob_matches(patterns, keyed, nid="_t", pattern_col="_pattern", path="path", path_key="_k", any_folder=True)
    plain = wanted.filter(~is_glob)
    same_path = plain.join(keyed, F.col("_t") == F.col("_k")).select("qid", "path")
    by_name = files.select(basename(source_key(F.col("path"))).alias("_name"), "path").groupBy("_name").agg(F.max("path").alias("path"))
    other = plain.join(keyed, F.col("_t") == F.col("_k"), "left_anti").withColumn("_name", basename(F.col("_t")))
    same_name = other.join(by_name, "_name", "left").select("qid", F.coalesce("path", "source").alias("path"))
    return globs.join(matched, "_t").select("qid", "path").unionByName(same_path).unionByName(same_name).distinct()


def recall_report(questions: DataFrame, retrieved: DataFrame, expected: DataFrame, files: DataFrame, ks=K_VALUES) -> DataFrame:
    """One row per question (qid): kind, expected files, found ones, first rank, recall at k, full coverage.

    ``retrieved`` is (qid, relative_path, rank), the cut lists that ``retrieve``
    gives.  A question without expected sources is unanswerable: its only
    measure is whether nothing was returned.
    """
    wanted = expand_expected(expected, files).select("qid", source_key(F.col("path")).alias("_k")).distinct()
    got = retrieved.groupBy("qid", source_key(F.col("relative_path")).alias("_k")).agg(F.min("rank").alias("rank"))
    hits = wanted.join(got, ["qid", "_k"], "left").groupBy("qid").agg(
        F.count("*").alias("expected"), F.count("rank").alias("found_total"), F.min("rank").alias("first_rank"), *[F.count_if(F.col("rank") <= k).alias(f"_at_{k}") for k in ks]
    )
    asked = expected.filter(source_key(F.col("source")) != "").select("qid").distinct().withColumn("_answerable", F.lit(True))
    returned = retrieved.select("qid").distinct().withColumn("_any", F.lit(True))
    rows = questions.select("qid").join(asked, "qid", "left").join(hits, "qid", "left").join(returned, "qid", "left")
    share = lambda c: F.when(F.col("_answerable"), F.coalesce(F.col(c) / F.col("expected"), F.lit(0.0)))  # noqa: E731  a glob without a file is not found
    return rows.select(
        "qid", F.when(F.col("_answerable"), F.lit("answerable")).otherwise(F.lit("unanswerable")).alias("kind"), F.coalesce("expected", F.lit(0)).alias("expected"),
        F.coalesce("found_total", F.lit(0)).alias("found_total"), "first_rank", *[share(f"_at_{k}").alias(f"recall_{k}") for k in ks], share("found_total").alias("recall_full"),
        F.col("_any").isNull().alias("returned_empty"),
    )


def recall_summary(report: DataFrame, ks=K_VALUES) -> DataFrame:
    """Means per kind of question, of the measures that the kind has."""
    means = [F.round(F.avg(c), 4).alias(c) for c in [f"recall_{k}" for k in ks] + ["recall_full"]]
    mrr = F.round(F.avg(F.when(F.col("kind") == "answerable", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))), 4).alias("mrr")
    whole = F.round(F.avg(F.when(F.col("kind") == "answerable", (F.col("recall_full") == 1).cast("double"))), 4).alias("fully_covered")
    empty = F.round(F.avg(F.col("returned_empty").cast("double")), 4).alias("returned_empty")
    return report.groupBy("kind").agg(F.count("*").alias("questions"), *means, mrr, whole, empty)
