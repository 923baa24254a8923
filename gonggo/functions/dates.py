"""Calendar dates out of text. An impossible date is NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gonggo.functions.regex import rx


def ymd(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d")


def date_in(text: Column, pattern: str, groups: tuple[int, int, int] = (1, 2, 3)) -> Column:
    """The date whose three parts are groups of the first match of `pattern`."""
    return F.when(text.isNotNull(), ymd(*(F.regexp_extract(text, rx(pattern), g) for g in groups)))
