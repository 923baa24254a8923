"""Removal of repeated byte strings, by the common-prefix interval tree of an enhanced suffix array.

All suffixes of all texts are too many to sort. But each string of `length` bytes has an anchor: of its
32-byte grams, the leftmost of least hash. Equal strings have their anchors at the same place, so it is
enough to sort the suffixes that begin at anchors whose gram occurs again. Sorted suffixes and their
common prefixes make an interval tree: each interval is a string and all suffixes that begin with it.
Within an interval, the same scan over what stands before the anchors tells how far, and with which
occurrences, the string can be extended to the left until its occurrences differ.

A gram that very many different surroundings share has one tree for each part of its strings: those that begin
at most so far ahead of the anchor, and those that begin further ahead. Either half shares more than the gram, so
its surroundings fall into smaller groups, which are halved again while they are too large. A task halves what it
can hold by itself; only larger groups are halved over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gonggo.llm import bytetext, exchange
from gonggo.llm.bytetext import mix
from gonggo.llm.names import fresh
from gonggo.session import arrow_rows, lookup, marked, short_lived, written

LENGTH, GRAM = 100, 32
# Different surroundings that a task sorts as one suffix array; larger groups are split by where strings begin,
# up to so many rows within a task (a few MB), beyond that in a shuffle.
GROUP_ROWS, TASK_ROWS = 512, 8192
# Texts or contexts that one Arrow batch holds, and places or contexts of one that goes back.
BATCH_ROWS, OUT_ROWS = 1000, 10_000
# Bytes of text that are looked at together in one task, and those that are hashed at a time.
BLOCK_BYTES, PIECE_BYTES = 128 << 20, 1 << 22
_PLACE_BITS = np.uint64(28)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place on."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | x[width:] << np.uint64(8 * width)
    a, b, c, d = bytetext.odd_numbers(4, 77)
    x = x[:-8] * a + mix(x[8:]) * b
    return mix(x[:-16] * c + mix(x[16:]) * d)


def _anchors(data: np.ndarray, length: int) -> np.ndarray:
    """Place of the anchor of each string of `length` bytes."""
    hashes = gram_hashes(data)
    least = hashes >> _PLACE_BITS << _PLACE_BITS | np.arange(len(hashes), dtype=np.uint64)
    window, width = length - GRAM + 1, 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[:-(window - width)], least[window - width:])
    return (least & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH,
            piece: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash and row of the anchors of all strings of `length` bytes within a row.

    Longer data is read in pieces, each with the strings that begin in it.
    """
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    last = -1
    for low in range(0, len(data) - length + 1, piece):
        part = data[low:low + piece + length - 1]
        found = _anchors(part, length)
        whole = np.ones(len(found), bool)
        inner = offsets[1:-1]
        for end in inner[np.searchsorted(inner, low, side="right"):np.searchsorted(inner, low + len(part))] - low:
            whole[max(end - length + 1, 0):end] = False
        found = found[whole]
        found = found[np.append(True, found[1:] != found[:-1])] if len(found) else found
        found = found[found + low > last]
        if len(found):
            last = int(found[-1]) + low
            places.append(found + low)
            hashes.append(gram_hashes(part)[found])
    where = np.concatenate(places)
    return where, np.concatenate(hashes), np.searchsorted(offsets, where, side="right") - 1


def surrounding_hashes(data: np.ndarray, begin: np.ndarray, at: np.ndarray, end: np.ndarray,
                       piece: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the bytes from `begin` to `end` and of how far `at` is from `begin`; `at` ascends."""
    hashes, checks = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    identity = np.arange(256, dtype=np.uint8)
    cuts = np.searchsorted(at, np.arange(0, len(data) + piece, piece))
    for low, high in zip(cuts, cuts[1:]):
        if low < high:
            base = int(begin[low:high].min())
            part = data[base:int(end[low:high].max())]
            one = bytetext.word_hashes(part, begin[low:high] - base, end[low:high] - base, identity)
            half = bytetext.word_hashes(part, at[low:high] - base, end[low:high] - base, identity)
            back = (at[low:high] - begin[low:high]).astype(np.uint64)
            hashes.append(mix(one + back))
            checks.append(mix(half + one * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(hashes), np.concatenate(checks)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as maximal runs; those that touch are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(shared: list[int], least: int) -> list[tuple[int, int, int]]:
    """(depth, low, high) of the common-prefix intervals of at least that depth.

    `shared[i]` is the common prefix of sorted strings i - 1 and i; one pass with a stack.
    """
    out, stack = [], [(-1, 0)]
    for i in range(1, len(shared) + 1):
        depth, low = (shared[i] if i < len(shared) else -1), i - 1
        while stack[-1][0] > depth:
            top, low = stack.pop()
            if top >= least:
                out.append((top, low, i - 1))
        if stack[-1][0] < depth:
            stack.append((depth, low))
    return out


def maximal_repeats(before: list[bytes], after: list[bytes], length: int = LENGTH) -> list[tuple[int, int, list[int]]]:
    """(left, right, occurrences) of each maximal repeat of at least `length` bytes around one gram.

    `after` are the texts from the gram on, sorted; `before` those ahead of it, read backwards. An
    interval of `after` gives the right end. The occurrences are sorted by what is ahead of them; each
    interval of that order is a left end beyond which the occurrences differ. Those that would all go
    on further to the right belong to a deeper interval and are left to it.
    """
    shared = [0] + [common(a, b) for a, b in zip(after, after[1:])]
    out = []
    for right, low, high in intervals(shared, GRAM):
        order = sorted(range(low, high + 1), key=before.__getitem__)
        left_shared = [0] + [common(before[a], before[b]) for a, b in zip(order, order[1:])]
        for left, first, last in intervals(left_shared, max(length - right, 0)):
            members = sorted(order[first:last + 1])
            if min(shared[members[0] + 1:members[-1] + 1]) == right:
                out.append((left, right, members))
    return out


_PLACES = T.StructType([T.StructField(n, t) for n, t in (
    ("gram", T.LongType()), ("hash", T.LongType()), ("check", T.LongType()), ("doc", T.LongType()), ("tie", T.LongType()),
    ("at", T.LongType()), ("back", T.IntegerType()), ("size", T.LongType()))])
_ARROW_PLACES = pa.schema([("gram", pa.int64()), ("hash", pa.int64()), ("check", pa.int64()), ("doc", pa.int64()),
                           ("tie", pa.int64()), ("at", pa.int64()), ("back", pa.int32()), ("size", pa.int64())])
_CONTEXTS = "gram long, at long, back int, context binary, doc long, tie long, k long"
_ARROW_CONTEXTS = pa.schema([("gram", pa.int64()), ("at", pa.int64()), ("back", pa.int32()), ("context", pa.binary()),
                             ("doc", pa.int64()), ("tie", pa.int64()), ("k", pa.int64())])
_SPANS = "doc long, tie long, start long, end long"
_ARROW_SPANS = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _keyed(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, int]:
    """doc (a null id comes first), tie (text hash), block and text; and the number of blocks.

    There are as many blocks as shuffle partitions, and more if they would hold more than BLOCK_BYTES of text.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(value).cast("bigint"))).first()[0] or 0
    blocks = max(exchange.bucket_count(docs.sparkSession), -(-total // BLOCK_BYTES))
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-2**63)).alias("doc"),
                        F.xxhash64(value).alias("tie"), value.alias("text"))
    return keyed.withColumn("block", _block(blocks)), blocks


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("doc", "tie"), F.lit(blocks)).cast("int")


def _ranks(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents and text hashes in their order, each row's place in it, and which places repeat the one before."""
    docs, ties = rows["doc"].to_numpy(), rows["tie"].to_numpy()
    order = np.lexsort((ties, docs))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    docs, ties = docs[order], ties[order]
    again = np.zeros(len(docs), bool)
    again[1:] = (docs[1:] == docs[:-1]) & (ties[1:] == ties[:-1])
    return docs, ties, rank, again


def places(keyed: DataFrame, blocks: int, length: int = LENGTH) -> DataFrame:
    """A written stage of the anchors whose gram occurs again, and hashes of what surrounds them, once per block.

    An anchor with the same surroundings as an earlier one of its block is a span to remove instead: a row
    without a gram. No text is written.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = exchange.Sender(blocks)
        for batch in bytetext.released(batches):
            data, offsets = bytetext.text_bytes(batch.column(1))
            block = batch.column(0).to_numpy(zero_copy_only=False)
            for low, high in bytetext.slices(offsets, bytetext.FINE_BYTES):
                _, hashes, rows = anchors(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], length)
                yield from sender.add(hashes, block[low + rows])
        yield from sender.flush()

    def surround(rows: pa.Table, answers: pa.Table) -> pa.Table:
        keys = exchange.known(answers)
        docs, ties, rank, again = _ranks(rows)
        found: list[tuple[np.ndarray, ...]] = []
        done = 0
        # Texts are read as they came; only what is found is put in order.
        for column in rows["text"].chunks:
            data, offsets = bytetext.text_bytes(column)
            for low, high in bytetext.slices(offsets, bytetext.FINE_BYTES):
                part, own = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
                at, grams, of = anchors(part, own, length)
                place = rank[done + low + of]
                keep = exchange.is_known(grams, keys) & ~again[place]
                at, grams, of, place = at[keep], grams[keep], of[keep], place[keep]
                begin, end = np.maximum(own[of], at - length + GRAM), np.minimum(own[of + 1], at + length)
                found.append((grams, *surrounding_hashes(part, begin, at, end), place, at - own[of], at - begin, end - begin))
            done += len(column)
        if not found:
            return _ARROW_PLACES.empty_table()
        columns = [list(c) for c in zip(*found)]
        found.clear()
        order = np.argsort(np.concatenate(columns[3]), kind="stable")
        for i, parts in enumerate(columns):
            columns[i] = np.concatenate(parts)[order]
            parts.clear()
        grams, hashes, checks, row, at, back, size = columns
        order = np.lexsort((checks, hashes, grams))
        same = (grams[order[1:]] == grams[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]]) & (checks[order[1:]] == checks[order[:-1]])
        later = np.zeros(len(order), bool)
        later[order[1:][same]] = True
        first, span = ~later, later & (size >= length)
        row_s, start, end = row[span], (at - back)[span], (at - back + size)[span]
        new = np.ones(len(row_s), bool)
        new[1:] = (row_s[1:] != row_s[:-1]) | (start[1:] > end[:-1])
        begin = np.flatnonzero(new)
        close = np.append(begin[1:], len(new))[:len(begin)] - 1
        runs, n = len(begin), int(first.sum())
        none = np.append(np.zeros(n, bool), np.ones(runs, bool))

        def both(one: np.ndarray, other: np.ndarray) -> np.ndarray:
            return np.concatenate([one, other])

        zeros = np.zeros(runs, np.int64)
        out = pa.table([
            pa.array(both(grams[first].view(np.int64), zeros), mask=none), pa.array(both(hashes[first].view(np.int64), zeros), mask=none),
            pa.array(both(checks[first].view(np.int64), zeros), mask=none), pa.array(docs[both(row[first], row_s[begin])]),
            pa.array(ties[both(row[first], row_s[begin])]), pa.array(both(at[first], start[begin])),
            pa.array(both(back[first], zeros).astype(np.int32)), pa.array(both(size[first], end[close] - start[begin]))], schema=_ARROW_PLACES)
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out.to_batches(max_chunksize=OUT_ROWS), _ARROW_PLACES)

    answers = exchange.repeated(keyed.select("block", "text").mapInArrow(send, exchange.SENT))
    return written(keyed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(surround, _PLACES), "places")


def contexts(asked: DataFrame, keyed: DataFrame, blocks: int) -> DataFrame:
    """A written stage of the bytes around the places in `asked` (gram, at, back, size, doc, tie, k)."""
    def fetch(wanted: pa.Table, rows: pa.Table) -> pa.Table:
        texts = [bytetext.text_bytes(column) for column in rows["text"].chunks]
        places = ((data, start) for data, offsets in texts for start in offsets[:-1].tolist())
        row = dict(zip(zip(rows["doc"].to_pylist(), rows["tie"].to_pylist()), places))
        out = []
        for batch in wanted.to_batches(max_chunksize=OUT_ROWS):
            pieces = []
            for doc, tie, at, back, size in zip(*(batch[c].to_pylist() for c in ("doc", "tie", "at", "back", "size"))):
                data, start = row[doc, tie]
                start += at - back
                pieces.append(data[start:start + size].tobytes())
            out.append(pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("gram", "at", "back")), pa.array(pieces, pa.binary()), *(batch[c] for c in ("doc", "tie", "k"))],
                schema=_ARROW_CONTEXTS))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out, _ARROW_CONTEXTS)

    asked = asked.withColumn("block", _block(blocks))
    return written(asked.groupBy("block").cogroup(keyed.groupBy("block")).applyInArrow(fetch, _CONTEXTS), "contexts")


_Row = tuple[int, int, bytes, int, int]


def halved_group(rows: list[_Row], low: int, high: int, length: int) -> tuple[list[tuple], list[list[_Row]]]:
    """Spans of rows that repeat an earlier one as a whole, and the groups of the others, sorted, where several are left.

    The rows (at, back, context, doc, tie) stand for the strings that begin `low` to `high` ahead of the anchor; in a
    group, they share all bytes that these strings share in place.
    """
    groups: dict[bytes, dict[tuple[int, bytes], tuple[int, int, int]]] = {}
    spans = []
    for at, back, context, doc, tie in rows:
        if back >= low and len(context) - back >= length - high:
            ahead = min(back, high)
            whole = context[back - ahead:back + length - low]
            firsts = groups.setdefault(context[back - low:back + length - high], {})
            place = doc, tie, at
            first = firsts.setdefault((ahead, whole), place)
            if place != first:
                if place < first:
                    firsts[ahead, whole], place = place, first
                if len(whole) >= length:
                    spans.append((place[0], place[1], place[2] - ahead, place[2] - ahead + len(whole)))
    several = [sorted([(at, back, context, doc, tie) for (back, context), (doc, tie, at) in firsts.items()],
                      key=lambda row: (row[2][row[1]:], row[3], row[4], row[0]))
               for firsts in groups.values() if len(firsts) > 1]
    return spans, several


def _solved(batches: Iterator[pa.RecordBatch], length: int, group_rows: int) -> Iterator[pa.RecordBatch]:
    """Spans of all but the first occurrence of each maximal repeat, group by group; rows come sorted."""
    def solve(rows: list[tuple]) -> list[tuple]:
        found, todo = [], [([row[1:6] for row in rows], *rows[0][6:])]
        while todo:
            group, low, high = todo.pop()
            if len(group) <= group_rows or low == high:
                found += tree(group)
                continue
            middle = (low + high) // 2
            for half in ((low, middle), (middle + 1, high)):
                spans, several = halved_group(group, *half, length)
                found += spans
                todo += [(part, *half) for part in several]
        return found

    def tree(group: list[_Row]) -> list[tuple]:
        before = [context[:back][::-1] for _, back, context, _, _ in group]
        after = [context[back:] for _, back, context, _, _ in group]
        spans: dict[int, list[tuple[int, int]]] = {}
        for left, right, members in maximal_repeats(before, after, length):
            first = min(members, key=lambda i: (group[i][3], group[i][4], group[i][0]))
            for i in members:
                if i != first:
                    spans.setdefault(i, []).append((group[i][0] - left, group[i][0] + right))
        return [(group[i][3], group[i][4], a, b) for i, found in spans.items() for a, b in merged(found)]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_ARROW_SPANS)

    group: list[tuple] = []
    out: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if group and group[0][0] != row[0]:
                out += solve(group)
                group = []
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
            group.append(row)
    if group:
        out += solve(group)
    if out:
        yield batch_of(out)


def _halved(hot: DataFrame, length: int) -> DataFrame:
    """Each row once for either half of the strings it stands for, by how far ahead of the anchor they begin.

    `low` and `high` bound that distance. The strings of a half share the bytes from `low` ahead of the anchor to
    `length` - `high` behind its start: rows with the same ones are a group. Nothing beyond `high` ahead and `length`
    - `low` behind matters to them, so that goes, and rows without room for any of the strings go.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high")))
    rows = hot.where("low < high").select("group", "at", "back", "context", "doc", "tie", F.explode(halves).alias("half")).select(
        "group", "at", "back", "context", "doc", "tie", "half.low", "half.high")
    rows = rows.where((F.col("back") >= F.col("low")) & (F.octet_length("context") - F.col("back") >= length - F.col("high")))
    ahead = F.least("back", "high")
    end = F.least(F.octet_length("context"), F.col("back") + length - F.col("low"))
    rows = rows.withColumn("context", F.substring("context", F.col("back") - ahead + 1, end - F.col("back") + ahead)).withColumn("back", ahead)
    shared = F.substring("context", F.col("back") - F.col("low") + 1, length - F.col("high") + F.col("low"))
    return rows.withColumns({"group": F.xxhash64("group", "low", "high", shared),
                             "hash": F.xxhash64("context"), "check": F.xxhash64(F.lit(1), "context")})


def _split_groups(hot: DataFrame, length: int, task_rows: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Spans of rows that repeat an earlier one as a whole, and the rows of groups that are small enough for a task.

    Each round halves the strings that a row stands for, in groups beyond that. In the last, they are single ones, and
    all rows of a group are equal. Equal rows are reduced to their first by counts that are aggregated before they are
    shuffled.
    """
    spans, small = [], [hot.where(F.col("k") <= task_rows)]
    hot = hot.where(F.col("k") > task_rows)
    while not hot.isEmpty():
        rows = _halved(hot, length)
        first = rows.groupBy("group", "hash", "check").agg(F.min(F.struct("doc", "tie", "at")).alias("f"), F.count("*").alias("n"))
        groups = first.groupBy("group").agg(F.count("*").alias("k"), F.sum("n").alias("n")).where("n > 1").select("group", "k")
        known = lookup(first.join(groups, "group").select(
            "group", "hash", "check", "k", *[F.col(f"f.{c}").alias(f"first_{c}") for c in ("doc", "tie", "at")]))
        told = written(rows.join(known, ["group", "hash", "check"]).withColumn(
            "first", (F.col("doc") == F.col("first_doc")) & (F.col("tie") == F.col("first_tie")) & (F.col("at") == F.col("first_at")))
            .where("k > 1 OR NOT first").select("group", "at", "back", "context", "doc", "tie", "low", "high", "k", "first"), "halves")
        start = F.col("at") - F.col("back")
        spans.append(told.where(~F.col("first") & (F.octet_length("context") >= length)).select(
            "doc", "tie", start.alias("start"), (start + F.octet_length("context")).alias("end")))
        small.append(told.where(F.col("first") & F.col("k").between(2, task_rows)))
        hot = told.where(F.col("first") & (F.col("k") > task_rows))
    return spans, small


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id",
                   group_rows: int = GROUP_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """doc, tie, spans: for each text with repeated strings, the byte ranges to remove, merged in order."""
    task_rows = max(task_rows, group_rows)
    keyed, blocks = _keyed(docs, text, doc_id)
    stage = places(keyed, blocks, length)
    rank = F.struct("doc", "tie", "at")
    same = Window.partitionBy("gram", "hash", "check")
    placed = written(stage.where("gram IS NOT NULL").withColumn("first", F.min(rank).over(same) == rank).drop("hash", "check"), "placed")
    start, end = F.col("at") - F.col("back"), F.col("at") - F.col("back") + F.col("size")
    copies = placed.where(~F.col("first") & (F.col("size") >= length)).select("doc", "tie", start.alias("start"), end.alias("end"))
    firsts = placed.where("first").drop("first")
    groups = firsts.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1")
    several = contexts(firsts.join(groups, "gram"), keyed, blocks)
    several = several.withColumnRenamed("gram", "group").withColumns({"low": F.lit(0), "high": F.lit(length - GRAM)})
    whole, parts = _split_groups(several.where(F.col("k") > group_rows), length, task_rows)
    after = F.expr("substring(context, CAST(back AS INT) + 1)")
    columns = ("group", "at", "back", "context", "doc", "tie", "low", "high")
    small = several.where(F.col("k") <= group_rows).select(*columns)
    for part in parts:
        small = small.unionByName(part.select(*columns))
    small = small.repartition("group").sortWithinPartitions("group", after, "doc", "tie", "at")
    spans = [stage.where("gram IS NULL").select("doc", "tie", start.alias("start"), end.alias("end")), copies, *whole,
             small.mapInArrow(lambda batches: _solved(batches, length, group_rows), _SPANS)]
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)

    @F.arrow_udf("array<struct<start:bigint,end:bigint>>")
    def as_runs(column: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for s in found])]
                         for found in column.to_pylist()],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    found = every.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    return found.select("doc", "tie", as_runs("s").alias("spans"))


def with_repeats(docs: DataFrame, *, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id",
                 out: str = "repeats", group_rows: int = GROUP_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """`docs` plus the array column `out`: byte ranges of the text that repeat an earlier string.

    A byte is in a range if a string of `length` bytes covers it that also begins earlier: in a text
    with a smaller doc_id, or earlier in the same text. Ranges that overlap or touch are one.

    A null text counts as empty, a null id comes before all others. Rows with the same id and the same
    text are one document and get the same ranges; rows with the same id and different texts are
    ordered by a hash of the text. A column named `out` is replaced; all others are kept.

    Grams whose hash occurs once are sorted out by trading packed hashes; equal surroundings (copies,
    the inside of shared passages) are reduced to their first by 128-bit hashes, in each block and then over
    all, and only surroundings of grams that keep several are read again from the texts. Groups of different
    surroundings are bounded suffix arrays; those beyond `group_rows` are split by where their strings begin
    until they are, in at most seven rounds for 100 bytes: within a task up to `task_rows` rows, beyond that in
    shuffles. Texts of any length are hashed in pieces of 4 MB.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    with short_lived(docs.sparkSession) as kept, arrow_rows(docs.sparkSession, BATCH_ROWS):
        spans = marked(kept(repeated_spans(docs, length=length, text=text, doc_id=doc_id, group_rows=group_rows, task_rows=task_rows)))
    d, t, doc, tie, found = fresh(docs, "d", "t", "doc", "tie", "found")
    spans = spans.select(F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("spans").alias(found))
    keyed = docs.withColumns({d: F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-2**63)), t: F.xxhash64(value)})
    joined = keyed.join(spans, (F.col(d) == F.col(doc)) & (F.col(t) == F.col(tie)), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return joined.withColumn(out, F.coalesce(found, none)).drop(*({d, t, doc, tie, found} - {out}))


def _cut(whole: bytes, spans: list[dict]) -> bytes:
    pieces, at = [], 0
    for span in spans:
        pieces.append(whole[at:span["start"]])
        at = span["end"]
    pieces.append(whole[at:])
    return b"".join(pieces)


def kept_sha256(text: Column, spans: Column) -> Column:
    """Hex digest of the bytes outside the ranges."""
    @F.arrow_udf(T.StringType())
    def digest(column: pa.Array, ranges: pa.Array) -> pa.Array:
        return pa.array([sha256(_cut((t or "").encode(), s)).hexdigest()
                         for t, s in zip(column.to_pylist(), ranges.to_pylist())], pa.string())

    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.size(spans) == 0, F.sha2(whole, 256)).otherwise(digest(F.when(F.size(spans) > 0, whole), spans))


def kept_text(text: Column, spans: Column) -> Column:
    """The text outside the ranges; a character that a range cuts stays whole."""
    @F.arrow_udf(T.StringType())
    def cut(column: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for value, found in zip(column.to_pylist(), ranges.to_pylist()):
            if value is None or not found:
                out.append(value)
                continue
            whole, inner = value.encode(), []
            for span in found:
                start, end = span["start"], span["end"]
                while start < end and whole[start] & 0xC0 == 0x80:
                    start += 1
                while end > start and end < len(whole) and whole[end] & 0xC0 == 0x80:
                    end -= 1
                inner.append({"start": start, "end": end})
            out.append(_cut(whole, inner).decode())
        return pa.array(out, pa.string())

    return F.when(F.size(spans) == 0, text.cast("string")).otherwise(
        cut(F.when(F.size(spans) > 0, text.cast("string")), spans))
