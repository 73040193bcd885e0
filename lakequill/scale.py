"""Guards that keep plans safe at cluster scale.

* ``settle`` writes an intermediate result to the shared checkpoint folder when
  it is read several times, so that losing an executor does not redo the work; ``store`` writes it as columns.
* ``broadcast_if_small`` hints a broadcast only after the size was measured.
* ``deal`` spreads short rows by a key ahead of costly work.
* ``widen`` spreads a scan that has fewer splits than the cluster has cores.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import checkpoint_dir, ship_package

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
STORED_GROUP = 16 * 1024 * 1024  # bytes of a row group of ``store``: a reader's task takes whole ones


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage."""
    ship_package(df.sparkSession)  # the plan may hold functions of this package
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Like ``settle``, as columns: for many rows of which each reader wants a few columns or values."""
    ship_package(df.sparkSession)
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", STORED_GROUP).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _row_bytes(df: DataFrame):
    """Bytes of one row: text and binary by length, arrays by element count, the rest as 8."""
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            size = F.octet_length(col)
        elif isinstance(field.dataType, T.BinaryType):
            size = F.octet_length(col)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            size = F.octet_length(F.array_join(col, " ")) + F.lit(16) * F.size(col)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            size = F.lit(16) * F.greatest(F.size(col), F.lit(0))
        else:
            size = F.lit(8)
        total = total + F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    return total


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure at most ``max_rows + 1`` rows of ``df`` and compare with both bounds."""
    probe = df.limit(max_rows + 1).select(_row_bytes(df).alias("b"))
    row = probe.agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return row["n"] <= max_rows and row["b"] <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the measured size is within bounds; otherwise leave the join to AQE."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan over the cores when its files give fewer splits than there are cores.

    One parquet row group is one split, so a small table arrives in a single
    task.  A large table has far more splits than cores and is left untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Spread short rows that costly work per row follows: by their bytes alone adaptive execution puts them into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
