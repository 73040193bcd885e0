"""Helpers that several operators of this folder use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or a name made from it that is no column of ``df`` yet."""
    taken = {c.lower() for c in df.columns}
    name, n = wish, 0
    while name.lower() in taken:
        n += 1
        name = f"{wish}_{n}"
    return name


def col(name: str):
    """A top-level column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text):
    """Lower-case A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)
