"""Regular-expression helpers over Spark columns."""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as kinds, _parser as parser

from pyspark.sql import Column, functions as F

# Fixed value: the 29 characters that count as white space in posting text.
# Java's \s holds only the six ASCII ones, so patterns below use this class.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_SPACE = r"[^\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def rx(pattern: str) -> str:
    """`\\s` and `\\S` in `pattern` widened to the class above.

    `(?d)` makes the newline the only character a plain dot does not match.
    """
    return "(?d)" + pattern.replace(r"\S", NOT_SPACE).replace(r"\s", SPACE)


# A pattern of more words than this is looked for as it is.
MAX_WORDS = 8


def words_needed(pattern: str) -> tuple[str, ...]:
    """Literal words of which every match of `pattern` holds one; none if there are no such few words."""
    try:
        tree = parser.parse(pattern)
    except re.error:
        return ()
    if tree.state.flags & re.IGNORECASE:
        return ()
    words = _needed(tree)
    return tuple(sorted(words)) if words and len(words) <= MAX_WORDS else ()


def _needed(tree) -> set[str] | None:
    """Of the parts that all matches have, the one with the fewest words, then the first."""
    choices, run = [], ""
    for kind, value in [*tree, (None, None)]:
        if kind is kinds.LITERAL:
            run += chr(value)
            continue
        if run:
            choices.append({run})
            run = ""
        if kind is kinds.SUBPATTERN:
            choices.append(None if value[1] & re.IGNORECASE else _needed(value[3]))
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] > 0:
            choices.append(_needed(value[2]))
        elif kind is kinds.BRANCH:
            each = [_needed(x) for x in value[1]]
            choices.append(set().union(*each) if all(each) else None)
    return min((c for c in choices if c), key=len, default=None)


def _may(text: Column, pattern: str) -> Column:
    """Whether the text holds a word that `pattern` needs: a search for bytes, many times cheaper than the pattern."""
    words = words_needed(pattern)
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words)) if words else F.lit(True)


def found(text: Column, pattern: str, quick: bool = False) -> Column:
    """Whether the pattern occurs. `quick`, here and below, looks for the words it needs first; for a plain column
    as `text`, since it is read several times."""
    hit = text.rlike(rx(pattern))
    return F.coalesce(_may(text, pattern) & hit if quick else hit, F.lit(False))


def first(text: Column, pattern: str, group: int = 1, quick: bool = False) -> Column:
    """The first match's group, NULL when there is none (or it is empty)."""
    hit = F.nullif(F.regexp_extract(text, rx(pattern), group), F.lit(""))
    return F.when(_may(text, pattern), hit) if quick else hit


def every(text: Column, pattern: str, group: int = 0, quick: bool = False) -> Column:
    """All matches, in order, as an array."""
    hits = F.regexp_extract_all(text, F.lit(rx(pattern)), F.lit(group))
    return F.when(~_may(text, pattern), F.array().cast("array<string>")).otherwise(hits) if quick else hits


def replaced(text: Column, pattern: str, by: str = " ") -> Column:
    return F.regexp_replace(text, rx(pattern), by)


def squeezed(text: Column) -> Column:
    """Runs of white space become one blank, the ends are cut."""
    return F.trim(replaced(text, r"\s+"))


def stripped(text: Column) -> Column:
    """White space cut from both ends only."""
    return F.regexp_replace(text, rx(r"^\s+|\s+\z"), "")
