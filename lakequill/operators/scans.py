"""Ordered computations over long groups, in two levels.

A window over one key runs in one task, and one key may hold a third of all
rows.  Here the order column is cut into blocks; each (key, block) is scanned
on its own, and only one summary row per block is scanned per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scale import broadcast_if_small

BLOCK = 4096


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / block).cast("long"))


def neighbour(df: DataFrame, keys: list[str], order: str, columns: dict[str, str], ahead: bool = True, block: int = BLOCK) -> DataFrame:
    """Add values of the next (or previous) row of the same key; ``columns`` maps new name to source."""
    shift = F.lead if ahead else F.lag
    blocked = _blocked(df, order, block)
    inside = W.partitionBy(*keys, "_block").orderBy(order)
    value = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    local = blocked.withColumn("_near", shift(value).over(inside))
    pick = F.min_by if ahead else F.max_by
    edges = blocked.groupBy(*keys, "_block").agg(pick(value, F.col(order)).alias("_edge"))
    across = edges.withColumn("_far", shift("_edge").over(W.partitionBy(*keys).orderBy("_block"))).drop("_edge")
    joined = local.join(across, keys + ["_block"], "left")
    chosen = F.coalesce("_near", "_far")
    return joined.select(*df.columns, *[chosen[new].alias(new) for new in columns])


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Inclusive running sum of ``value`` per key."""
    blocked = _blocked(df, order, block)
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = blocked.withColumn("_local", F.sum(value).over(inside))
    totals = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_total"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    joined = local.join(offsets, keys + ["_block"])
    return joined.select(*df.columns, (F.col("_local") + F.col("_offset")).alias(out))


def percentiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], bins: int = 10_000) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per key and one column per fraction.

    A quantile sketch (partial in each task) brackets every wanted rank between
    two values, whatever the values' spread.  Values below a bracket are only
    counted; those inside, about ten times the sketch's error, are counted one
    by one and ordered.  ``bins`` is the resolution of the sketch.
    """
    known = df.filter(F.col(value).isNotNull())
    slack, names = 10 / bins, list(fractions)
    probes = [p for f in fractions.values() for p in (max(0.0, f - slack), min(1.0, f + slack))]
    sketch = known.groupBy(*keys).agg(
        F.percentile_approx(value, F.array(*[F.lit(p) for p in probes]), F.lit(bins)).alias("_q"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        F.count("*").alias("_n"),
    )
    brackets = []
    for i, f in enumerate(fractions.values()):
        few = F.col("_n") < 4 / slack  # the slack is less than a rank or two: all values are ordered
        low = F.when(few | F.lit(f - slack <= 0), F.col("_lo")).otherwise(F.get("_q", F.lit(2 * i)))
        high = F.when(few | F.lit(f + slack >= 1), F.col("_hi")).otherwise(F.get("_q", F.lit(2 * i + 1)))
        brackets.append(F.struct(F.lit(i).alias("i"), low.alias("low"), high.alias("high"), ((F.col("_n") - 1) * F.lit(f)).alias("pos")))
    bounds = sketch.select(*keys, F.array(*brackets).alias("_b"))
    near = F.filter("_b", lambda b: F.col(value) <= b["high"])
    rows = known.select(*keys, value).join(broadcast_if_small(bounds), keys).select(*keys, value, F.explode(near).alias("_b"))
    counted = rows.groupBy(*keys, "_b.i", "_b.pos", F.when(F.col(value) >= F.col("_b.low"), F.col(value)).alias("_v")).agg(F.count("*").alias("_c"))
    upto = W.partitionBy(*keys, "i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counted.withColumn("_cum", F.sum("_c").over(upto))
    low = F.min(F.when(F.col("_cum") > F.floor("pos"), F.col("_v")))
    high = F.min(F.when(F.col("_cum") > F.ceil("pos"), F.col("_v")))
    found = ranked.groupBy(*keys, "i", "pos").agg(low.alias("_low"), high.alias("_high"))
    exact = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("pos") - F.floor("pos"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, exact)).alias(n) for i, n in enumerate(names)])


def percentile(df: DataFrame, keys: list[str], value: str, fraction: float, out: str, bins: int = 10_000) -> DataFrame:
    """One exact percentile, one row per key."""
    return percentiles(df, keys, value, {out: fraction}, bins)
