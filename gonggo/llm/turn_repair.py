"""Repair of conversation structure by cheapest edits, decided by one integer minimum.

A repaired conversation reads (system)? (user assistant)+, or is empty. A path of edits through a small graph
(rows seen, place in that grammar, letters written) has one integer as its weight: the high digits carry its
cost, and the low digits, of fixed number, its edit letters from the left, with zeros at the end. The smaller
integer is the cheaper path, or of equally cheap ones the one whose letters come first, so ordinary minima over
sums decide everything.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
# Letters in ASCII order are digits 1 to 4; 0 is the padding.
_LETTERS = "".join(sorted((DELETE, INSERT, KEEP, REROLE)))
_BITS = 3
COST = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
TRUNCATED_COST = 3
# What follows costs at most this much more from one place than from another: a system turn goes, two are inserted.
SLACK = COST[DELETE] + 2 * COST[INSERT]
# Rows that are decided on together, and rows of one outgoing batch.
STEP_ROWS, OUT_ROWS = 16, 500

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
# Places in the grammar: nothing yet, behind a system, user or assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_WHOLE = (START, ASSISTANT)

# A path that may still be the best one: place, letters not yet decided, cost.
Path = tuple[int, str, int]
BEGIN: tuple[Path, ...] = ((START, "", 0),)

SPACE = " \t\n\x0b\x0c\r"


class _Weights:
    """Integers for paths of up to `width` letters."""

    def __init__(self, width: int):
        self.width, self.low = width, _BITS * width

    def edge(self, letter: str, place: int, cost: int) -> int:
        return (cost << self.low) + ((_LETTERS.index(letter) + 1) << _BITS * (self.width - 1 - place))

    def path(self, letters: str, cost: int) -> int:
        return (cost << self.low) + sum(self.edge(x, i, 0) for i, x in enumerate(letters))

    def read(self, weight: int) -> tuple[str, int]:
        digits = ((weight >> _BITS * (self.width - 1 - i)) & 7 for i in range(self.width))
        return "".join(_LETTERS[d - 1] for d in digits if d), weight >> self.low


Nodes = dict[tuple[int, int], int]


def _reach(nodes: Nodes, place: int, written: int, weight: int) -> None:
    at = place, written
    if at not in nodes or weight < nodes[at]:
        nodes[at] = weight


def _with_inserts(nodes: Nodes, weights: _Weights) -> Nodes:
    """Up to two inserted turns; a third would repeat a place that is already reached."""
    every, last = dict(nodes), nodes
    for _ in range(2):
        more: Nodes = {}
        for (place, written), w in last.items():
            _reach(more, _NEXT[place], written + 1, w + weights.edge(INSERT, written, COST[INSERT]))
        for (place, written), w in more.items():
            _reach(every, place, written, w)
        last = more
    return every


@lru_cache(maxsize=100_000)
def advance(front: tuple[Path, ...], codes: str) -> tuple[tuple[Path, ...], str]:
    """The paths that may still be best after more rows, and the letters that all of them begin with.

    A row's code is the initial of its role, upper case if the row is truncated, or '-' if it must go.
    Of the paths at one place, only the cheapest can win, and of these only such whose letters begin one
    another's; the others are behind already, whatever follows. So are those that cost over `SLACK` more than any.
    """
    weights = _Weights(max(len(p[1]) for p in front) + 3 * len(codes))
    nodes: Nodes = {}
    for place, letters, cost in front:
        _reach(nodes, place, len(letters), weights.path(letters, cost))
    for code in codes:
        after: Nodes = {}
        extra, role = TRUNCATED_COST * code.isupper(), code.lower()
        for (place, written), w in _with_inserts(nodes, weights).items():
            _reach(after, place, written + 1, w + weights.edge(DELETE, written, COST[DELETE]))
            if code == "-":
                continue
            if (place, role) in _KEPT:
                _reach(after, _KEPT[place, role], written + 1, w + weights.edge(KEEP, written, COST[KEEP] + extra))
            _reach(after, _NEXT[place], written + 1, w + weights.edge(REROLE, written, COST[REROLE] + extra))
        nodes = after
    least: dict[int, int] = {}
    paths = [(place, *weights.read(w)) for (place, _), w in nodes.items()]
    for place, _, cost in paths:
        least[place] = min(cost, least.get(place, cost))
    alive: list[Path] = []
    most = min(least.values()) + SLACK
    for place, letters, cost in sorted(paths):
        if cost == least[place] <= most and (not alive or alive[-1][0] != place or letters.startswith(alive[-1][1])):
            alive.append((place, letters, cost))
    decided = commonprefix([p[1] for p in alive])
    floor = min(p[2] for p in alive)
    return tuple((place, letters[len(decided):], cost - floor) for place, letters, cost in alive), decided


@lru_cache(maxsize=100_000)
def finished(front: tuple[Path, ...]) -> str:
    """The letters of the best path, after inserts at the end."""
    weights = _Weights(max(len(p[1]) for p in front) + 3)
    nodes: Nodes = {}
    for place, letters, cost in front:
        _reach(nodes, place, len(letters), weights.path(letters, cost))
    return weights.read(min(w for (place, _), w in _with_inserts(nodes, weights).items() if place in _WHOLE))[0]


class _Repair:
    """One conversation, row by row; what is not decided yet is held."""

    def __init__(self, conv):
        self.conv, self.place, self.edits = conv, START, 0
        self.front, self.codes, self.rows = BEGIN, [], deque()

    def take(self, turn, role: str, text: str, fault: str | None) -> Iterator[tuple]:
        self.rows.append((turn, role, text, fault))
        self.codes.append("-" if fault in (BLANK, DUPLICATE) else _code(role, fault))
        if len(self.codes) == STEP_ROWS:
            yield from self._decide()

    def _decide(self) -> Iterator[tuple]:
        self.front, letters = advance(self.front, "".join(self.codes))
        self.codes = []
        yield from self._edited(letters)

    def end(self) -> Iterator[tuple]:
        if self.codes:
            yield from self._decide()
        yield from self._edited(finished(self.front))
        if not self.edits:
            yield self.conv, 0, None, None, None, None, None, None, None

    def _edited(self, letters: str) -> Iterator[tuple]:
        for x in letters:
            self.edits += 1
            if x == INSERT:
                self.place = _NEXT[self.place]
                yield self.conv, self.edits, x, COST[x], None, None, None, _ROLES[self.place], ""
                continue
            turn, role, text, fault = self.rows.popleft()
            cost = COST[x] + TRUNCATED_COST * (fault == TRUNCATED and x != DELETE)
            if x == KEEP:
                self.place = _KEPT[self.place, role[:1]]
                yield self.conv, self.edits, x, cost, turn, role, fault, role, text
            elif x == REROLE:
                self.place = _NEXT[self.place]
                yield self.conv, self.edits, x, cost, turn, role, fault, _ROLES[self.place], text
            else:
                yield self.conv, self.edits, x, cost, turn, role, fault, None, None


def _code(role: str, fault: str | None) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if fault == TRUNCATED else initial


_EDITS = ("conv_id long, place long, edit string, cost int, turn long, old_role string, fault string, role string, text string")
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 4]
_NAMES = [c.split()[0] for c in _EDITS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, out = None, []
    for batch in batches:
        for conv, there, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if current is None or conv != current.conv:
                if current is not None:
                    out += current.end()
                current = _Repair(conv)
            if there:
                out += current.take(turn, role, text, fault)
            if len(out) >= OUT_ROWS:
                yield _batch(out)
                out = []
    if current is not None:
        out += current.end()
    if out:
        yield _batch(out)


def repaired(turns: DataFrame, *, there: Column | None = None, conv: str = "conv_id", turn: str = "turn",
             role: str = "role", text: str = "text") -> DataFrame:
    """The edits of each conversation, in order: conv_id, place (from 1), edit, cost, turn, old_role, fault, role, text.

    Rows go by turn, null first, then by role and text. A row's fault is the first of: blank (nothing but
    blanks and the controls 9 to 13), duplicate (an earlier row has its role and text), truncated (its
    last other character is none of .!?). K keeps a row, R gives it the role user or assistant, D takes it out
    (role and text are then null), I is an inserted turn without text. Blank and duplicate rows go; a
    truncated row that stays costs 3 more. Of all edits that give (system)? (user assistant)+ or nothing, by
    the initials of the roles, the cheapest are taken, and of these the ones whose letters come first.

    Rows where `there` is false only name their conversation; one without any row has a single row without
    edit, place 0. A null role or text is one blank, rows without a conversation id make one conversation
    without id, other columns are left out.

    All edits of a conversation lie in one partition, in order. A task reads its rows in that order and holds
    those that are not decided yet (mostly some 16), so a very long conversation is a long stream, not a large row.
    """
    words = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    core = F.btrim(words, F.lit(SPACE))
    said = F.coalesce(F.col(role).cast("string"), F.lit(" "))
    rows = turns.select(
        F.col(conv).cast("bigint").alias("conv_id"), (F.lit(True) if there is None else F.coalesce(there, F.lit(False))).alias("there"),
        F.col(turn).cast("bigint").alias("turn"), said.alias("role"), words.alias("text"),
        F.when(core == "", BLANK).when(~F.right(core, F.lit(1)).isin(".", "!", "?"), TRUNCATED).alias("fault"),
        F.md5(F.concat(F.length(said).cast("string"), F.lit(":"), said, words)).alias("same"))
    again = F.row_number().over(Window.partitionBy("conv_id", "there", "same").orderBy("turn")) > 1
    faulty = rows.repartition("conv_id").withColumn(
        "fault", F.when((F.col("fault") == BLANK).eqNullSafe(True) | ~again, F.col("fault")).otherwise(DUPLICATE))
    return (faulty.select("conv_id", "there", "turn", "role", "text", "fault")
            .sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_repaired, _EDITS))


_REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
_LEGAL = {"su", "ua", "au"}


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
    names = [c.split()[0] for c in _REPORT.split(", ")]
    key, s, out = None, None, []

    def row() -> tuple:
        gaps = s["high"] - s["low"] + 1 - s["turns"] if s["turns"] else 0
        return (key[0], min(gaps, 2 ** 63 - 1), *(s["faults"][f] for f in (BLANK, DUPLICATE, TRUNCATED)), s["illegal"], s["cost"],
                "".join(s["audit"]), s["text"].hexdigest())

    for batch in batches:
        for conv, _, edit, cost, turn, old, fault, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (conv,) != key:
                if s:
                    out.append(row())
                key = (conv,)
                s = {"faults": dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0), "illegal": 0, "cost": 0, "audit": [],
                     "text": hashlib.sha256(), "first": True, "turns": 0, "high": None, "low": None, "before": None}
            if edit is None:
                continue
            s["cost"] += cost
            s["audit"].append(edit)
            if fault:
                s["faults"][fault] += 1
            if edit != INSERT:
                s["illegal"] += s["before"] is not None and s["before"] + old[:1] not in _LEGAL
                s["before"] = old[:1]
                if turn is not None and turn != s["high"]:
                    s["turns"], s["high"] = s["turns"] + 1, turn
                    s["low"] = turn if s["low"] is None else s["low"]
            if edit != DELETE:
                s["text"].update((("" if s["first"] else "\n") + f"{role}:{text}").encode())
                s["first"] = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out = []
    if s:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*[row()]), kinds)], names)


def reports(edits: DataFrame) -> DataFrame:
    """One row per conversation of `repaired`, in its partitions: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256.

    gaps are the turn numbers missing between the smallest and the largest; illegal counts neighbours, before
    the repair, whose initials are not su, ua or au; audit joins the edits' letters; the digest covers
    the repaired turns as role:text lines. A conversation without rows has zeros and empty texts.
    """
    return edits.mapInArrow(_reports, _REPORT)
