"""Which 64-bit keys occur more than once, found by trading packed blocks of keys.

Single keys would cost a row each in a shuffle. Here the keys of one block (rows that are looked at
together) and one bucket (keys by a hash) travel as one array; the answer travels back by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gonggo.llm import bytetext

SENT = "bucket int, keys binary, blocks binary"
ANSWERED = "block int, keys binary"
# Keys a sender holds before it sends them.
HELD_KEYS = 1_000_000


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Sender:
    """Gathers keys and their blocks, and gives them out as packed rows, one for each bucket.

    What a sender meets twice it knows to be repeated: it tells the blocks itself, in rows that only pass
    through (their bucket is below 0), and the bucket gets the key once, without a block to answer.
    """

    def __init__(self, buckets: int):
        self.buckets, self.keys, self.blocks, self.held = buckets, [], [], 0

    def add(self, keys: np.ndarray, blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.blocks.append(blocks)
        self.held += len(keys)
        if self.held >= HELD_KEYS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        keys, blocks = np.concatenate(self.keys), np.concatenate(self.blocks).astype(np.int32)
        self.keys, self.blocks, self.held = [], [], 0
        order = np.argsort(keys, kind="stable")
        keys, blocks = keys[order], blocks[order]
        again = np.zeros(len(keys), bool)
        again[1:] = keys[1:] == keys[:-1]
        twice = again.copy()
        twice[:-1] |= again[1:]
        yield from self._pass(keys[twice], blocks[twice])
        blocks[twice] = -1
        keys, blocks = keys[~again], blocks[~again]
        # Callers send the least of many hashes: as ranges of the keys themselves, the first bucket would hold most of them.
        buckets = ((bytetext.mix(keys) >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(buckets, kind="stable")
        keys, blocks, buckets = keys[order], blocks[order], buckets[order]
        begin = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
        yield self._rows(buckets[begin], np.split(keys, begin[1:]), np.split(blocks, begin[1:]))

    def _pass(self, keys: np.ndarray, blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            order = np.lexsort((keys, blocks))
            keys, blocks = keys[order], blocks[order]
            begin = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
            yield self._rows(-1 - blocks[begin], [np.unique(k) for k in np.split(keys, begin[1:])], [np.zeros(0, np.int32)] * len(begin))

    @staticmethod
    def _rows(buckets: np.ndarray, keys: list[np.ndarray], blocks: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(buckets.astype(np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()),
             pa.array([b.tobytes() for b in blocks], pa.binary())], ["bucket", "keys", "blocks"])


def _answers(bucket: int, packed: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    """Each block's keys of one bucket that came more than once, or from a sender that knew it."""
    keys = np.concatenate([np.frombuffer(k, np.uint64) for k, _ in packed])
    if bucket < 0:
        return pa.RecordBatch.from_arrays([pa.array([-1 - bucket], pa.int32()), pa.array([np.unique(keys).tobytes()], pa.binary())],
                                          ["block", "keys"])
    blocks = np.concatenate([np.frombuffer(b, np.int32) for _, b in packed])
    order = np.argsort(keys, kind="stable")
    keys, blocks = keys[order], blocks[order]
    repeated = blocks < 0
    repeated[1:] |= keys[1:] == keys[:-1]
    repeats = np.unique(keys[repeated])
    asked = is_known(keys, repeats) & (blocks >= 0)
    keys, blocks = keys[asked], blocks[asked]
    order = np.argsort(blocks, kind="stable")
    keys, blocks = keys[order], blocks[order]
    begin = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else np.zeros(0, np.int64)
    parts = np.split(keys, begin[1:]) if len(begin) else []
    return pa.RecordBatch.from_arrays([pa.array(blocks[begin], pa.int32()), pa.array([np.unique(p).tobytes() for p in parts], pa.binary())],
                                      ["block", "keys"])


def repeated(sent: DataFrame) -> DataFrame:
    """For each block, its keys that were sent at least twice in all, in any blocks.

    A key comes to its bucket at most once from each batch of keys, so one that a third of all rows
    hold is no larger there than the number of batches. A task holds one bucket at a time.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, packed = None, []
        for batch in bytetext.released(batches):
            for bucket, keys, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != current and packed:
                    yield _answers(current, packed)
                    packed = []
                current = bucket
                packed.append((keys, blocks))
        if packed:
            yield _answers(current, packed)

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(find, ANSWERED)


def known(answers: pa.Table) -> np.ndarray:
    """All keys of one block's answers, sorted."""
    packed = answers["keys"].to_pylist()
    return np.sort(np.concatenate([np.frombuffer(p, np.uint64) for p in packed])) if packed else np.zeros(0, np.uint64)


def is_known(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys
