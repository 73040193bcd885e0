"""Mixing sources to target weights by distributed prefix sums.

Every document gets a hash-random key; inside a source the documents are
ordered by it.  Equal ranges of the key space cut each source into buckets of a
few thousand rows, so a hot source is many groups.  Words are summed per
bucket, the bucket sums are summed up along each source, and a running sum
inside the bucket gives each document's place.  A source's budget is its target
in whole words: complete epochs first, then the documents up to the cut; the
document at the cut gives only its words before it.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; an empty table gives an empty result; repeated rows are separate
documents.  Two runs agree: the order depends on id, text and size only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scale import broadcast_if_small, settle
from .shared import WORD, col

#: Weights of the sources in order, share of all words to take, most epochs.
WEIGHTS, SHARE, EPOCHS = (3.0, 1.0, 2.0), 1.5, 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Per source: sid, source_size, n_docs, target.  ``sizes`` has source and size.

    A target stops at ``epochs`` times its source; the excess is reshared by
    weight.  With the sources in order of cap/weight, the first one that the
    level of those left does not fill gives the final level.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sums.withColumn("sid", F.row_number().over(order) - 1)
    wish = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    rows = ranked.withColumns({"w": wish, "cap": F.lit(float(epochs)) * F.col("source_size")})
    by = W.orderBy(F.col("cap") / F.col("w"), "sid")
    rows = rows.withColumns({
        "budget": F.lit(share) * F.sum("source_size").over(W.partitionBy()),
        "cap_before": F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)),
        "w_left": F.sum("w").over(by.rowsBetween(W.currentRow, W.unboundedFollowing)),
    })
    level = (F.col("budget") - F.coalesce("cap_before", F.lit(0.0))) / F.col("w_left")
    rows = rows.withColumn("level", F.when(level <= F.col("cap") / F.col("w"), level))
    # levels fall no further once one fits; the first that fits is the smallest place
    rows = rows.withColumn("final", F.first("level", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("w")), F.col("cap"))
    return rows.select("sid", "source", "source_size", "n_docs", target.alias("target"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, bucket_rows: int = 4096,
) -> DataFrame:
    """``docs`` with size, source_size, target, taken and epochs_full.

    Columns of these names in ``docs`` are replaced; all others are carried.
    """
    made = ("size", "source_size", "target", "taken", "epochs_full")
    base = docs.drop(*[c for c in docs.columns if c.lower() in made])
    keep = [c for c in base.columns]
    text = col(text_col)
    sized = base.select(
        *[col(c).alias(f"_c{i}") for i, c in enumerate(keep)],
        col(source_col).alias("_source"), col(id_col).alias("_id"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))).alias("_key"),
    )
    narrow = settle(sized.select(F.col("_source").alias("source"), "size", F.substring("_key", 1, 8).alias("head")))
    targets = settle(source_targets(narrow, weights, share, epochs))
    place = targets.withColumnRenamed("source", "_source")
    bucket = F.floor(F.conv(F.col("head"), 16, 10).cast("long") * F.ceil(F.col("n_docs") / F.lit(bucket_rows)) / F.lit(2**32)).cast("long")
    sums = (
        narrow.join(broadcast_if_small(targets), narrow["source"].eqNullSafe(targets["source"]))
        .groupBy("sid", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    )
    before = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset"))
    rows = sized.withColumn("head", F.substring("_key", 1, 8)).join(broadcast_if_small(place), sized["_source"].eqNullSafe(place["_source"]))
    inside = W.partitionBy("sid", "bucket").orderBy("_key", "_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("bucket", bucket).withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offsets, ["sid", "bucket"])
    budget = F.floor(F.col("target") + 0.5).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    full = F.least(full, F.lit(epochs).cast("long"))
    left = budget - full * F.col("source_size") - F.col("offset") - F.col("ahead")
    part = F.greatest(F.lit(0).cast("long"), F.least(left, F.col("size")))
    part = F.when(full >= epochs, F.lit(0).cast("long")).otherwise(part)
    return rows.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target",
        (full * F.col("size") + part).alias("taken"), full.alias("epochs_full"),
    )
