"""Exact substring joins without comparing all pairs.

A text can contain a needle only if it holds every unit (word or n-gram) of
the needle.  Each needle picks its rarest unit as the anchor, candidates come
from an equi-join on that anchor, and the exact test runs on candidates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import rows_of
from ..functions.text import BLANK
from ..scale import broadcast_if_small, settle


def grams(text: Column, width: int) -> Column:
    """Distinct substrings of a fixed width."""
    size = F.length(text)
    every = F.transform(
        F.sequence(F.lit(1), F.greatest(size - width + 1, F.lit(1))), lambda i: F.substring(text, i, width)
    )
    return F.when(size >= width, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def anchored_candidates(hay: DataFrame, needles: DataFrame, hid: str, nid: str) -> DataFrame:
    """(hid, nid) pairs that share the needle's rarest unit.

    ``hay`` is (hid, unit) and ``needles`` is (nid, unit), both distinct.
    """
    wanted = needles.select("unit").distinct()
    postings = settle(hay.join(broadcast_if_small(wanted), "unit"))
    freq = postings.groupBy("unit").agg(F.count("*").alias("df"))
    rated = needles.join(freq, "unit", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    anchors = (
        rated.groupBy(nid)
        .agg(F.min("df").alias("_least"), F.min(F.struct("df", "unit")).alias("_anchor"))
        .filter(F.col("_least") > 0)
        .select(nid, F.col("_anchor.unit").alias("unit"))
    )
    return postings.join(anchors, "unit").select(hid, nid)


def contains_pairs(hay: DataFrame, needles: DataFrame, *, hid: str, hay_col: str, nid: str, needle_col: str, width: int = 5) -> DataFrame:
    """(hid, nid) where the needle, of one character or more, occurs in the hay text.  For short texts such as names."""
    needles = needles.filter(F.length(needle_col) > 0)
    own = F.least(F.length(needle_col), F.lit(width))
    # At most ``width`` distinct values reach the driver.
    widths = sorted(r[0] for r in needles.select(own.alias("w")).distinct().collect())
    if not widths:
        return hay.sparkSession.createDataFrame([], T.StructType([hay.schema[hid], needles.schema[nid]]))
    hay_units = F.flatten(F.array(*[grams(F.col(hay_col), w) for w in widths]))
    needle_units = F.lit(None).cast("array<string>")
    for w in widths:
        needle_units = F.when(own == w, grams(F.col(needle_col), w)).otherwise(needle_units)
    pairs = anchored_candidates(
        rows_of(hay, [hid], hay_units, "unit"), rows_of(needles, [nid], needle_units, "unit"), hid, nid
    )
    return _verify(pairs, hay, needles, hid, hay_col, nid, needle_col)


def passages_in_texts(texts: DataFrame, passages: DataFrame, *, hid: str, hay_col: str, nid: str, needle_col: str) -> DataFrame:
    """(hid, nid) where the passage occurs verbatim in the text.  For long texts.

    Words strictly inside a passage are whole words of any text that contains
    it.  A passage of one or two words has none; its longest piece is looked up
    in the vocabulary instead.
    """
    parts = F.split(F.col(needle_col), f"{BLANK}+")
    inner = passages.withColumn("_inner", F.array_distinct(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))))
    hay_words = rows_of(texts, [hid], F.array_distinct(F.split(F.col(hay_col), f"{BLANK}+")), "unit")
    long = inner.filter(F.size("_inner") > 0).select(nid, F.explode("_inner").alias("unit"))
    pairs = anchored_candidates(hay_words, long, hid, nid)
    pieces = F.filter(parts, lambda p: p != "")
    short = inner.filter((F.size("_inner") == 0) & (F.size(pieces) > 0)).select(
        nid, F.reduce(pieces, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a)).alias("_piece")
    )
    if not short.isEmpty():
        vocabulary = settle(hay_words.select(F.col("unit").alias("_word")).distinct())
        hits = contains_pairs(
            vocabulary.withColumn("_text", F.col("_word")), short, hid="_word", hay_col="_text", nid=nid, needle_col="_piece"
        )
        held = hay_words.withColumnRenamed("unit", "_word").join(hits, "_word")
        pairs = pairs.unionByName(held.select(hid, nid).distinct())
    return _verify(pairs, texts, passages, hid, hay_col, nid, needle_col)


def _verify(pairs: DataFrame, hay: DataFrame, needles: DataFrame, hid: str, hay_col: str, nid: str, needle_col: str) -> DataFrame:
    """Keep the pairs whose texts really match; long texts stay in place while the pairs are small."""
    pairs = settle(pairs.join(needles.select(nid, F.col(needle_col).alias("_needle")), nid))
    checked = hay.select(hid, F.col(hay_col).alias("_hay")).join(broadcast_if_small(pairs), hid)
    return checked.filter(F.contains("_hay", F.col("_needle"))).select(hid, nid)
