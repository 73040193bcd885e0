"""Helpers for array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind an expression once and use it several times inside ``body``.

    A plain column would be inlined into the lambdas and computed per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rows_of(df, keep: list, array: Column, name: str):
    """One row per element.

    The outer form is used on purpose: for the plain form the optimiser adds a
    filter on the array's size, which computes an expensive array twice and
    can move that work below a repartition.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def numbered_rows(df, keep: list, array: Column, position: str, name: str):
    """One row per element with its position; see :func:`rows_of`."""
    return df.select(*keep, F.posexplode_outer(array).alias(position, name)).filter(F.col(position).isNotNull())
