"""Benchmark decontamination by a broadcast set of test n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gonggo.llm import bytetext
from gonggo.session import written

N_WORDS = 10
# Broadcast bound: windows of the test set in one table, about 150 bytes each in a worker.
MAX_WINDOWS = 500_000

SCAN_TYPE = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

_ARROW_SCAN = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


class TestWindows:
    """The test windows of one part: hash -> (window bytes, items), by window length."""

    def __init__(self, windows: dict[int, dict[int, tuple[bytes, tuple[str, ...]]]]):
        self.windows = windows
        self.hashes = {n: np.sort(np.fromiter(found, np.uint64, len(found))) for n, found in windows.items()}
        self.marks = {}
        for n, hashes in self.hashes.items():
            self.marks[n] = np.zeros(1 << 20, bool)
            self.marks[n][(hashes >> np.uint64(44)).astype(np.int64)] = True

    def __len__(self) -> int:
        return sum(map(len, self.windows.values()))


def _normal(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(mapped[a:b].tobytes() for a, b in zip(starts, ends))


def windows_of_items(items: list[tuple[str, str | None]], n_words: int = N_WORDS) -> dict:
    """All windows of the items' texts, by length; an item of fewer words is one window."""
    found: dict[int, dict[int, tuple[bytes, set[str]]]] = {}
    for item, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        offsets = np.array([0, len(data)])
        starts, ends, rows = bytetext.words(data, offsets, bytetext.LETTER_WORDS)
        if not len(starts):
            continue
        n = min(n_words, len(starts))
        mapped = bytetext.LETTER_WORDS[data]
        hashes, _ = bytetext.window_hashes(
            bytetext.word_hashes(data, starts, ends, bytetext.LETTER_WORDS), rows, n)
        for i, h in enumerate(hashes.tolist()):
            window = _normal(mapped, starts[i:i + n], ends[i:i + n])
            if found.setdefault(n, {}).setdefault(h, (window, set()))[0] != window:
                raise ValueError("two test windows share a hash")
            found[n][h][1].add(item)
    return {n: {h: (w, tuple(sorted(ids))) for h, (w, ids) in by.items()} for n, by in found.items()}


def _scan_slice(data: np.ndarray, offsets: np.ndarray, before: list, test: TestWindows) -> list[dict]:
    rows_in = len(offsets) - 1
    starts, ends, rows = bytetext.words(data, offsets, bytetext.LETTER_WORDS)
    hashes = bytetext.word_hashes(data, starts, ends, bytetext.LETTER_WORDS)
    cover = np.zeros(len(starts) + 1, np.int64)
    items: dict[int, set[str]] = {}
    mapped = bytetext.LETTER_WORDS[data]
    for row, scan in enumerate(before):
        if scan and scan["spans"]:
            items[row] = set(scan["item_ids"])
            for span in scan["spans"]:
                cover[np.searchsorted(starts, offsets[row] + span["start"])] += 1
                cover[np.searchsorted(starts, offsets[row] + span["end"])] -= 1
    for n, known in test.hashes.items():
        window, whole = bytetext.window_hashes(hashes, rows, n)
        maybe = np.flatnonzero(whole & test.marks[n][(window >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(known, window[maybe]), len(known) - 1)
        for i in maybe[known[at] == window[maybe]].tolist():
            text, ids = test.windows[n][int(window[i])]
            if _normal(mapped, starts[i:i + n], ends[i:i + n]) == text:
                cover[i] += 1
                cover[i + n] -= 1
                items.setdefault(int(rows[i]), set()).update(ids)
    hit = np.cumsum(cover[:-1]) > 0
    n_words = np.bincount(rows, minlength=rows_in)
    n_hit = np.bincount(rows[hit], minlength=rows_in)
    out = [{"n_words": w, "n_hit": h, "item_ids": [], "spans": []} for w, h in zip(n_words.tolist(), n_hit.tolist())]
    first = hit.copy()
    first[1:] &= ~(hit[:-1] & (rows[1:] == rows[:-1]))
    last = hit.copy()
    last[:-1] &= ~(hit[1:] & (rows[1:] == rows[:-1]))
    for a, b in zip(np.flatnonzero(first), np.flatnonzero(last)):
        row = int(rows[a])
        out[row]["spans"].append({"start": int(starts[a] - offsets[row]), "end": int(ends[b] - offsets[row])})
    for row, found in items.items():
        out[row]["item_ids"] = sorted(found)
    return out


def _scan_batch(column: pa.Array, before: pa.Array, test: TestWindows) -> list[dict]:
    data, offsets = bytetext.text_bytes(column)
    earlier = before.to_pylist() if before.null_count < len(before) else [None] * len(column)
    out: list[dict] = []
    for low, high in bytetext.slices(offsets):
        out += _scan_slice(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low],
                           earlier[low:high], test)
    return out


_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _items(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[str, str | None]]:
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    for row in rows.where("i IS NOT NULL").toLocalIterator():
        yield row.i, row.t


def _pieces(text: str, n_words: int, most: int) -> Iterator[tuple[str, int]]:
    """The text in pieces of up to `most` windows each, and how many they are; no window is lost between them."""
    words = [m.span() for m in _WORDS.finditer(text)]
    for at in range(0, max(len(words) - n_words + 1, 1), most):
        part = words[at:at + most + n_words - 1]
        yield (text[part[0][0]:part[-1][1]] if part else ""), max(len(part) - n_words + 1, 1)


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", n_words: int = N_WORDS, out: str = "contamination",
                  max_windows: int = MAX_WINDOWS) -> DataFrame:
    """`docs` plus a struct column `out`: n_words, n_hit, item_ids, spans (bytes of the text).

    Words are runs of ASCII letters and digits and of all code points beyond ASCII, A-Z lower-cased.
    Each `n_words` consecutive words of an item are a window, all words of a shorter item are one. The
    windows go into one broadcast hash table, and every document is scanned where it lies: there is no
    shuffle. A hash that hits is verified on the words. A test set of more than `max_windows` windows
    goes through as many tables of that bound, one scan each, so that no broadcast grows with it; the
    driver reads it by iterator and holds one table's items at a time.

    Null or wordless texts have no words and no hits; items without an id or words are left out;
    repeated items and windows count once. A column named `out` is replaced; all others are kept.
    """
    spark = docs.sparkSession
    result = docs.withColumn(out, F.lit(None).cast(SCAN_TYPE))

    def scanned(df: DataFrame, items: list) -> DataFrame:
        table = spark.sparkContext.broadcast(TestWindows(windows_of_items(items, n_words)))

        @F.arrow_udf(SCAN_TYPE)
        def scan(column: pa.Array, before: pa.Array) -> pa.Array:
            return pa.array(_scan_batch(column, before, table.value), type=_ARROW_SCAN)

        return df.withColumn(out, scan(F.col(text).cast("string"), F.col(out)))

    waiting: list[tuple[str, str | None]] = []
    size = 0
    for item in _items(benchmark, item_id, item_text):
        for piece, windows in _pieces(item[1] or "", n_words, max_windows):
            waiting.append((item[0], piece))
            size += windows
            if size >= max_windows:
                result, waiting, size = written(scanned(result, waiting), "decontaminate"), [], 0
    return scanned(result, waiting)


def contaminated(out: str = "contamination") -> Column:
    """Whether any word of the document is hit."""
    return F.col(out)["n_hit"] > 0


def without_hits(text: str = "text", out: str = "contamination") -> Column:
    """The text without its hit words: what lies between the spans, joined by a blank."""
    @F.arrow_udf(T.StringType())
    def cut(column: pa.Array, found: pa.Array) -> pa.Array:
        kept = []
        for value, scan in zip(column.to_pylist(), found.to_pylist()):
            if value is None or not scan["spans"]:
                kept.append(value)
                continue
            whole, at, pieces = value.encode(), 0, []
            for span in scan["spans"]:
                pieces.append(whole[at:span["start"]].strip())
                at = span["end"]
            pieces.append(whole[at:].strip())
            kept.append(b" ".join(p for p in pieces if p).decode())
        return pa.array(kept, pa.string())

    return cut(F.col(text).cast("string"), F.col(out))
