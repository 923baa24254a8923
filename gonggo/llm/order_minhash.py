"""Document fingerprints by order MinHash.

A text is a sequence of tokens: runs of non-blank bytes, longer ones in pieces of 24 bytes. Its k-mers
are each token with the next k - 1 (or an end mark in their place), numbered by how often they have
occurred before. Each of m hash functions picks the l least numbered k-mers; these k-mers, in text
order, hash to one entry of the signature. Two texts agree in an entry if the same k-mers were picked
and stand in the same order, so the share of equal entries falls with the edit distance, and unlike
plain MinHash also when parts of a text change places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gonggo.llm import bytetext
from gonggo.llm.bytetext import mix

ENTRIES, KMER, PICKED = 64, 2, 2
TOKEN_BYTES = 24
_TOKENS = bytetext.byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
_TOKENS[65:91] = np.arange(65, 91)
_END = np.uint64(0x5851F42D4C957F2D)
# The low bits of a hash value hold the k-mer's place, so that the minimum tells where it stands.
_PLACE_BITS = 28


def kmers(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each k-mer, in text order."""
    starts, ends, rows = bytetext.words(data, offsets, _TOKENS, TOKEN_BYTES)
    tokens = bytetext.word_hashes(data, starts, ends, _TOKENS)
    total = np.zeros(len(tokens), np.uint64)
    for j, factor in enumerate(bytetext.odd_numbers(k, 11)):
        shifted = np.full(len(tokens), _END)
        shifted[:len(tokens) - j] = np.where(rows[j:] == rows[:len(rows) - j], tokens[j:], _END)
        total += mix(shifted + factor) * factor
    return mix(total), rows


def numbered(found: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hash of each k-mer with its occurrence number in its row."""
    if not len(found):
        return found
    key = mix(found ^ mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    begin = np.flatnonzero(new)
    nth = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
    count = np.empty(len(key), np.uint64)
    count[order] = nth
    return mix(found + count * np.uint64(0x9E3779B97F4A7C15))


def signatures(data: np.ndarray, offsets: np.ndarray, m: int = ENTRIES, k: int = KMER,
               picked: int = PICKED, seed: int = 0) -> np.ndarray:
    """rows x m entries of 16 bits; a text without tokens has zeros."""
    out = np.zeros((len(offsets) - 1, m), np.uint16)
    found, rows = kmers(data, offsets, k)
    if not len(found):
        return out
    if len(found) >= 1 << _PLACE_BITS:
        raise ValueError("a text has too many tokens")
    hashes = numbered(found, rows)
    begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    place = np.arange(len(found), dtype=np.uint64)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    chosen = np.empty((picked, len(begin)), np.int64)
    factors, shifts = bytetext.odd_numbers(m, 100 + seed), bytetext.odd_numbers(m, 200 + seed)
    parts = bytetext.odd_numbers(picked, 300)
    value = np.empty_like(hashes)
    for i in range(m):
        np.bitwise_xor(hashes, shifts[i], out=value)
        np.multiply(value, factors[i], out=value)
        np.bitwise_and(value, ~low, out=value)
        np.bitwise_or(value, place, out=value)
        for j in range(picked):
            least = np.minimum.reduceat(value, begin)
            at = (least & low).astype(np.int64)
            gone = least == none
            chosen[j] = np.where(gone, len(found), at)
            value[at[~gone]] = none
        in_order = np.sort(chosen, axis=0)
        entry = np.zeros(len(begin), np.uint64)
        for j in range(picked):
            there = in_order[j] < len(found)
            entry += np.where(there, mix(found[np.minimum(in_order[j], len(found) - 1)] + parts[j]), _END) * parts[j]
        out[rows[begin], i] = (mix(entry) >> np.uint64(48)).astype(np.uint16)
    return out


def fingerprint(text: Column, m: int = ENTRIES, k: int = KMER, picked: int = PICKED) -> Column:
    """The signature of each whole text as 2 * m bytes; null counts as empty, equal texts get equal ones."""
    @F.arrow_udf(T.BinaryType())
    def signed(column: pa.Array) -> pa.Array:
        data, offsets = bytetext.text_bytes(column)
        out: list[bytes] = []
        for low, high in bytetext.slices(offsets):
            rows = signatures(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], m, k, picked)
            out += [row.tobytes() for row in rows.astype(">u2")]
        return pa.array(out, pa.binary())

    return signed(text.cast("string"))


def likeness(left: Column, right: Column) -> Column:
    """The share of equal entries of two fingerprints, 0 to 1; null if either is null."""
    @F.arrow_udf(T.DoubleType())
    def share(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else
                         float((np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)).mean())
                         for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return share(left, right)


def with_fingerprints(docs: DataFrame, texts: dict[str, str], *, m: int = ENTRIES, k: int = KMER,
                      picked: int = PICKED) -> DataFrame:
    """`docs` plus one fingerprint column per entry of `texts` (new column -> text column).

    Texts are read whole, in place, without a shuffle; a task works on about 1 MB of text (or one longer
    text) at a time. Columns of the new names are replaced, all others kept.
    """
    return docs.withColumns({name: fingerprint(F.col(text), m, k, picked) for name, text in texts.items()})


def in_blocks(docs: DataFrame, key: str) -> DataFrame:
    """Rows of `docs` in blocks of neighbouring keys: __block, __extra, __wrap, and the rows' own columns.

    Ordered by `__wrap`, then key descending, each block's last row is followed by the row that comes
    after it in the whole table, as an extra copy (`__extra`); the first row of all follows the last
    (`__wrap`). Block limits are approximate quantiles, which are keys that occur, so blocks are even
    and no window runs over the whole table.
    """
    blocks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limits, most = docs.agg(
        F.percentile_approx(key, [i / blocks for i in range(1, blocks)], 20 * blocks), F.max(key)).first()
    bounds = np.unique(np.array(limits or [], np.int64))

    @F.arrow_udf(T.IntegerType())
    def block(column: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, column.to_numpy(zero_copy_only=False)).astype(np.int32))

    @F.arrow_udf(T.BooleanType())
    def limit(column: pa.Array) -> pa.Array:
        return pa.array(np.isin(column.to_numpy(zero_copy_only=False), bounds))

    def place(at: Column, extra: bool, wrap: bool) -> Column:
        return F.array(F.struct(at.cast("int").alias("__block"), F.lit(extra).alias("__extra"), F.lit(wrap).alias("__wrap")))

    none = F.slice(place(F.lit(0), False, False), F.lit(1), F.lit(0))
    placed = docs.withColumns({"__at": block(F.col(key)), "__limit": limit(F.col(key))})
    return placed.select(*docs.columns, F.inline(F.concat(
        place(F.col("__at"), False, False),
        F.when(F.col("__limit"), place(F.col("__at") + 1, True, False)).otherwise(none),
        F.when(F.col(key) == F.lit(most), place(F.lit(0), True, True)).otherwise(none))))


def after(order_key: str, *ties: str) -> Window:
    """The window of `in_blocks` rows, by descending key."""
    return Window.partitionBy("__block").orderBy("__wrap", F.col(order_key).desc(), *ties)
