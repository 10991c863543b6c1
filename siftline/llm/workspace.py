"""Intermediate tables of the operators (see ``siftline.staging``), and rows by their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.staging import SMALL_ROWS, clean, drop, lookup, shared_dir, stage

__all__ = ["SMALL_ROWS", "clean", "drop", "lookup", "numbered", "shared_dir", "stage"]
BLOCK = 4096


def numbered(df: DataFrame, count: str, name: str) -> DataFrame:
    """Each row as often as its column ``count`` says, numbered from 1 in ``name`` in place of it.

    In two steps, so that no array is longer than a block or the number of blocks.
    """
    rest = [c for c in df.columns if c != count]
    blocks = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / BLOCK))).alias("_block"))
    last: Column = F.least(F.col(count), (F.col("_block") + 1) * BLOCK).cast("long")
    return blocks.select(*rest, F.explode(F.sequence((F.col("_block") * BLOCK + 1).cast("long"), last)).alias(name))
