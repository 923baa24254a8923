"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed(df: DataFrame, *columns: Column, keep: tuple[str, ...] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) plus the given named columns.

    The columns come out of inline() over one struct. The optimizer does not
    copy an expression from below such a step into the readers above it, nor
    push a filter on its output through it, so a costly text expression runs
    once per row however often later stages refer to it.
    """
    return df.select(*(keep if keep is not None else ("*",)), F.inline(F.array(F.struct(*columns))))
