"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

CAPACITIES = (512, 1024, 2048, 4096, 8192)
# Pieces that are packed against each other; what a task holds at a time.
PACK_ROWS = 50_000


@dataclass(frozen=True)
class Cost:
    """Cost of one training sequence: a fixed part, one per token, and one per pair of tokens."""

    fixed: float = 64.0
    token: float = 1.0
    pair: float = 1 / 65536

    def __call__(self, size: int) -> float:
        return self.fixed + self.token * size + self.pair * size * size


def opening_size(length: int, sizes: Sequence[int], largest: int, cost: Callable[[int], float]) -> int:
    """The size with the least cost per token of room that holds `length`; the larger one of equals.

    Sizes beyond `largest` are opened only for pieces that need them.
    """
    fitting = [s for s in sizes if s >= length]
    allowed = [s for s in fitting if s <= largest] or fitting[:1]
    return min(allowed, key=lambda s: (cost(s) / s, -s))


def best_fit(lengths: Sequence[int], sizes: Sequence[int], largest: int,
             cost: Callable[[int], float]) -> list[list[int]]:
    """Bins of indices into `lengths`: longest piece first, each into the open bin that it fills best."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # free tokens and bin, sorted
    opened: dict[int, int] = {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        at = bisect_left(room, (need, -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
        else:
            if need not in opened:
                opened[need] = opening_size(need, sizes, largest, cost)
            free, b = opened[need], len(bins)
            bins.append([i])
        if free > need:
            insort(room, (free - need, b))
    return bins


def smallest_size(used: int, sizes: Sequence[int]) -> int:
    return sizes[bisect_left(sizes, used)]


def pack(lengths: Sequence[int], sizes: Sequence[int] = CAPACITIES,
         cost: Callable[[int], float] = Cost()) -> list[tuple[int, list[int]]]:
    """(size, indices) of the cheapest packing found.

    The permitted sizes are weighed together: best fit runs once for each size as the largest that may
    be opened freely; every bin is then cut down to the smallest size that holds it, and the packing
    of least total cost stays (of equals, the one with the larger sizes).
    """
    best: tuple[float, list[tuple[int, list[int]]]] | None = None
    for largest in sorted(sizes, reverse=True):
        bins = best_fit(lengths, sizes, largest, cost)
        sized = [(smallest_size(sum(lengths[i] for i in b), sizes), b) for b in bins]
        total = sum(cost(s) for s, _ in sized)
        if best is None or total < best[0]:
            best = total, sized
    return best[1] if best else []


def pieces_of(docs: DataFrame, length: str, doc_id: str, sizes: Sequence[int], separator: int) -> DataFrame:
    """doc_id, start, length: documents cut where they exceed the largest size, each end with its separator."""
    most = max(sizes)
    n = F.greatest(F.coalesce(F.col(length).cast("bigint"), F.lit(0)), F.lit(0)) + F.lit(separator)
    whole = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), n.alias("__n")).where("__n > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(most).cast("bigint")))
    return whole.select("doc_id", "__n", starts.alias("start")).select(
        "doc_id", "start", F.least(F.lit(most).cast("bigint"), F.col("__n") - F.col("start")).alias("length"))


def packed(docs: DataFrame, *, length: str = "n_tokens", doc_id: str = "doc_id",
           sizes: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = Cost(),
           separator: int = 1, rows: int = PACK_ROWS) -> DataFrame:
    """One row per training sequence: bin_id, capacity, used, n_pieces, cost, doc_ids, pieces.

    A document takes its tokens and `separator` more; one of more than the largest size is cut into
    full pieces and a rest, so every token of every row is in exactly one piece. Null and negative lengths
    count as 0, and such documents take the separator alone (with separator 0 they take no place).
    Repeated rows are packed as often as they occur; null ids stay null; other columns are left out.

    Only ids and lengths move: they are dealt evenly in turn, whatever ids or sources hold most rows,
    and each task packs what it gets in lots of up to `rows` pieces, in an order that a hash decides.
    Lots do not grow with the data, and their number does.
    """
    sizes = tuple(sorted(set(int(s) for s in sizes)))
    if not sizes or sizes[0] <= 0 or separator < 0:
        raise ValueError("sizes must be positive, the separator at least 0")
    pieces = pieces_of(docs, length, doc_id, sizes, separator)
    lots = max(1, -(-pieces.count() // rows))

    def lot_rows(batch: pa.Table, first: int) -> pa.RecordBatch:
        ids, starts = batch["doc_id"].to_pylist(), batch["start"].to_pylist()
        lengths = batch["length"].to_pylist()
        out = []
        for k, (size, members) in enumerate(pack(lengths, sizes, cost)):
            used = sum(lengths[i] for i in members)
            out.append({"bin_id": first + k, "capacity": size, "used": used, "n_pieces": len(members),
                        "cost": float(cost(size)), "doc_ids": [ids[i] for i in members],
                        "pieces": [{"doc_id": ids[i], "start": starts[i], "length": lengths[i]} for i in members]})
        return pa.RecordBatch.from_pylist(out, schema=_ARROW_BINS)

    def pack_lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - held)
                waiting.append(part)
                held += part.num_rows
                batch = batch.slice(part.num_rows)
                if held == rows:
                    out = lot_rows(pa.Table.from_batches(waiting), first)
                    first, waiting, held = first + out.num_rows, [], 0
                    yield out
        if held:
            yield lot_rows(pa.Table.from_batches(waiting), first)

    order = F.xxhash64("doc_id", "start")
    dealt = pieces.repartition(lots).sortWithinPartitions(order, "doc_id", "start", "length")
    return dealt.mapInArrow(pack_lots, _BINS)


_BINS = T.StructType([
    T.StructField("bin_id", T.LongType()), T.StructField("capacity", T.LongType()), T.StructField("used", T.LongType()),
    T.StructField("n_pieces", T.LongType()), T.StructField("cost", T.DoubleType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("pieces", T.ArrayType(T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])))])
_ARROW_BINS = pa.schema([
    ("bin_id", pa.int64()), ("capacity", pa.int64()), ("used", pa.int64()), ("n_pieces", pa.int64()),
    ("cost", pa.float64()), ("doc_ids", pa.list_(pa.int64())),
    ("pieces", pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])))])
