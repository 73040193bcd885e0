"""Cells whose rows are compared with each other, split so that none is one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_cells(rows: DataFrame, ident: str, block_rows: int, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` (with a long column ``cell``) with part and side, cells of one row left out.

    A cell of more than ``block_rows`` rows is dealt into parts by ``ident``;
    part i meets itself (side 0: pairs among all) and every other part j (sides
    1 and 2: pairs across), each meeting under a ``part`` number of its own.
    """
    shared = (rows if counted is None else counted).groupBy("cell").agg(F.count("*").alias("_n")).filter("_n > 1")
    rows = rows.join(shared, "cell").withColumn("_n", F.ceil(F.col("_n") / block_rows).cast("int"))
    rows = rows.withColumn("_mine", F.pmod(F.xxhash64(ident, F.lit(3)), F.col("_n")).cast("int"))
    meet = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda j: F.struct(
            (F.least(F.col("_mine"), j).cast("long") * F.col("_n") + F.greatest(F.col("_mine"), j)).alias("part"),
            F.when(j == F.col("_mine"), 0).when(F.col("_mine") < j, 1).otherwise(2).alias("side"),
        ),
    )
    rest = [c for c in rows.columns if c not in ("_n", "_mine")]
    return rows.select(*rest, F.explode_outer(meet).alias("_m")).select(*rest, "_m.part", "_m.side")


def _changes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row differs from the one before in a key."""
    other = np.zeros(max(0, rows.num_rows - 1), bool)
    for name in keys:
        values = rows[name].to_numpy()
        other |= values[1:] != values[:-1]
    return np.flatnonzero(other) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of sorted batches, cut only between groups; many small groups stay in one table."""
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        joined = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), rows]) if held else rows
        cuts = _changes(joined, keys) - bool(held)
        if not len(cuts):
            held.append(rows)
            continue
        yield_ = pa.concat_tables([*held, rows.slice(0, cuts[-1])])
        held = [rows.slice(cuts[-1])]
        if yield_.num_rows:
            yield yield_
    if held:
        yield pa.concat_tables(held)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of sorted batches, one for each group."""
    for rows in whole_groups(batches, keys):
        cuts = np.r_[0, _changes(rows, keys), rows.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield rows.slice(a, b - a)
