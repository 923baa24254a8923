"""Exact ranks inside groups of any size.

A window over a group that holds a third of all rows would sort that third in
one task. Here each group is cut into slices of the sort key first: rows are
ranked inside a slice, and the sizes of the slices before it (a small table)
give the offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gonggo.functions.joins import small_side
from gonggo.session import written

HASH_BITS = 60
# Rows that one slice of a group is to hold, about.
SLICE_ROWS = 20_000


def hash_order(seed: int, *cols: str) -> Column:
    """A pseudo-random but repeatable sort key in 0 .. 2^60.

    Taken from MD5, so other engines can repeat the same choice.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)))
    return F.conv(F.left(digest, F.lit(HASH_BITS // 4)), 16, 10).cast("long")


def rank_in_group(df: DataFrame, group: list[str], order_key: str, tie: str,
                  out: str = "rank", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rank (from 1) of each row in its group by the hash `order_key`, then `tie`.

    The key is a hash, so equal-width slices hold about the same number of rows
    however many rows a group has; how many slices there are follows from the largest group. `df`
    should be narrow: it is written once, and sizes and ranks read that. Adds `out` and the group's
    size `out`_n.
    """
    df = written(df, "ranked")
    largest = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    width = (1 << HASH_BITS) // max(1, -(-largest // slice_rows))
    sliced = df.withColumn("_slice", F.expr(f"{order_key} div {width}"))
    sizes = sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice")
    whole = Window.partitionBy(*group)
    offsets = sizes.select(
        *group, "_slice",
        (F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole).alias(out + "_n"))
    inside = Window.partitionBy(*group, "_slice").orderBy(order_key, tie)
    ranked = sliced.withColumn("_pos", F.row_number().over(inside))
    keys = [*group, "_slice"]
    return (ranked.join(small_side(offsets), keys)
            .withColumn(out, F.col("_pos") + F.col("_before"))
            .drop("_slice", "_pos", "_before"))
