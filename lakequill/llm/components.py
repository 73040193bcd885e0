"""Connected components of a link table, by alternating large and small stars.

Links stay in Spark: every round is two aggregations and two joins, written to
the shared checkpoint folder.  A node with very many links is only ever
aggregated (minimum) and joined (adaptive execution splits its rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import settle


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step on links (u > v): every neighbour moves to the smallest one."""
    if large:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of ``links``; the root is the smallest node reachable."""
    now = settle(
        links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if (mark["n"], mark["x"]) == before:
            break
        before = (mark["n"], mark["x"])
        now = settle(_star(_star(now, large=True), large=False))
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
