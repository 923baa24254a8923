"""Missing values arrive in several shapes; here they become NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gonggo.functions.regex import stripped

# Spellings of "no value" in the source files.
BLANK_WORDS = ("", "None", "nan")


def blank_to_null(text: Column) -> Column:
    return F.when(stripped(text).isin(*BLANK_WORDS), None).otherwise(text)


def nan_to_null(number: Column) -> Column:
    return F.when(F.isnan(number), None).otherwise(number)


def kept(*conditional: Column) -> Column:
    """An array of the given values without its NULLs, order kept."""
    return F.filter(F.array(*conditional), lambda x: x.isNotNull())
