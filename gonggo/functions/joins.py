"""Joins that must not shuffle their big side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gonggo.session import LOOKUP_BYTES, lookup


def small_side(table: DataFrame, max_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """A narrow lookup table, marked for broadcast if its measured bytes allow.

    It is written as a Parquet stage first, so measuring and joining it compute it once. Beyond
    the bound it is returned unmarked, and the join is a shuffled one whose hot keys adaptive
    execution splits.
    """
    return lookup(table, max_bytes)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all of the session's shuffle partitions by `keys`.

    For narrow inputs whose rows fan out later: adaptive execution sizes
    partitions by the bytes going in and would give such a stage few tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
