"""Language identification with blended-spectrum presence kernels.

A text is the set of byte n-grams (n = 1, 2, 3) that occur in it, once A-Z are lower-cased and runs of
ASCII that is no letter are one blank. k(x, y) is the number of n-grams they share over the geometric
mean of their numbers. Nyström landmarks give each text a vector of bounded length, and one-versus-rest
kernel ridge regression on these vectors gives a value for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gonggo.llm.bytetext import text_bytes
from gonggo.session import lookup, written

# Bounds of the fit: different labelled texts of each language and in all, and landmarks of each language.
ROWS_PER_LANGUAGE, ROWS, LANDMARKS_PER_LANGUAGE = 300, 3000, 32
# Languages that are learned; with more, each of them would have few rows.
LANGUAGES = 300
RIDGE = 1e-3
UNKNOWN = "und"

# Slots of the presence vector: bytes, byte pairs, and byte triples hashed to 16 bits.
_ONE, _TWO = 256, 256 + 65536
SLOTS = _TWO + 65536

_LOWER = np.full(256, 32, np.uint8)
_LOWER[97:123] = _LOWER[65:91] = np.arange(97, 123)
_LOWER[128:] = np.arange(128, 256)


def presence(data: np.ndarray) -> np.ndarray:
    """Which slots occur in one text; an all-blank text has none."""
    seen = np.zeros(SLOTS, np.uint8)
    low = _LOWER[data]
    blank = low == 32
    keep = np.ones(len(low), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    low = low[keep].astype(np.uint32)
    if not len(low) or (low == 32).all():
        return seen
    seen[low] = 1
    two = low[:-1] << np.uint32(8) | low[1:]
    seen[_ONE + two] = 1
    three = (two[:-1] << np.uint32(8) | low[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16)
    seen[_TWO + three] = 1
    return seen


def normed(counts: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(counts, 1)).astype(np.float32)


@dataclass
class Model:
    """Landmarks over the slots that any of them holds, and weights from kernel values to languages."""

    languages: list[str]
    slots: np.ndarray      # slots some landmark holds
    landmarks: np.ndarray  # those slots x landmarks, scaled by each landmark's norm
    weights: np.ndarray    # landmarks x languages
    offset: np.ndarray

    def values(self, seen: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """One row per text: presence of `slots` in, a value for each language out."""
        kernel = (seen.astype(np.float32) @ self.landmarks) * normed(sizes)[:, None]
        return kernel @ self.weights + self.offset


def _scores(values: np.ndarray) -> np.ndarray:
    """Values to shares between 0 and 1 that sum to 1."""
    e = np.exp(6 * (values - values.max(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def fit(languages: list[str], seen: np.ndarray, labels: np.ndarray,
        landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression of +1/-1 per language on Nyström features of the landmarks.

    The first `landmarks` rows of each language are its landmarks.
    """
    chosen = np.concatenate([np.flatnonzero(labels == k)[:landmarks] for k in range(len(languages))])
    slots = np.flatnonzero(seen[chosen].any(axis=0))
    sizes = seen.sum(axis=1, dtype=np.int64)
    scaled = seen[np.ix_(chosen, slots)].T.astype(np.float32) * normed(sizes[chosen])[None, :]
    # Row by row block, as single-precision copies of all rows would be the largest thing in the driver.
    kernel = np.concatenate([seen[low:low + 128, slots].astype(np.float32) @ scaled for low in range(0, len(seen), 128)])
    kernel *= normed(sizes)[:, None]
    values, vectors = np.linalg.eigh(kernel[chosen].astype(np.float64))
    keep = values > 1e-6 * values.max()
    to_features = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ to_features
    # A language counts as much as any other, however many rows it has.
    weight = (1 / np.bincount(labels, minlength=len(languages)))[labels]
    mean = (features * weight[:, None]).sum(axis=0) / weight.sum()
    centred = features - mean
    target = np.where(labels[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    centre = (target * weight[:, None]).sum(axis=0) / weight.sum()
    gram = centred.T @ (centred * weight[:, None]) / weight.sum()
    solved = np.linalg.solve(gram + ridge * np.eye(len(gram)),
                             centred.T @ ((target - centre) * weight[:, None]) / weight.sum())
    return Model(languages, slots, scaled, (to_features @ solved).astype(np.float32),
                 (centre - mean @ solved).astype(np.float32))


def training_rows(docs: DataFrame, learn: Column, text: str, lang: str,
                  rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """The `rows` different labelled texts of each language with the smallest hashes, packed as their presence bits.

    Copies of a text count once, so no language is missed and no copy group comes whole. Of more than
    `LANGUAGES` values of `lang` those with the most different texts are learned. Of each language
    only about twice as many hashes as asked for are ranked; what leaves a task is at most 16 KB per
    text, however long it is.
    """
    labelled = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).cast("string").alias("__text"), F.col(lang).cast("string").alias("__lang")).withColumn(
        "__order", F.xxhash64("__text"))
    texts = written(labelled.select("__lang", "__order").distinct(), "labelled")
    known = texts.groupBy("__lang").count().orderBy(F.desc("count"), "__lang").limit(LANGUAGES)
    counts = {r[0]: r[1] for r in known.collect()}
    rows = min(rows, ROWS // max(len(counts), 1))
    if not counts:
        return labelled.select("__lang", F.lit(None).cast("binary").alias("__bits"), "__order").limit(0)
    limits = F.create_map(*[x for k, n in sorted(counts.items()) for x in (
        F.lit(k), F.lit(min((1 << 63) - 1, ((2 * rows + 100) << 64) // n - (1 << 63))).cast("bigint"))])
    place = F.row_number().over(Window.partitionBy("__lang").orderBy("__order"))
    smallest = texts.where(F.col("__order") <= limits[F.col("__lang")]).withColumn("__place", place)
    chosen = lookup(smallest.where(F.col("__place") <= rows).select("__lang", "__order"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            first = [i for i, key in enumerate(keys) if not (key in met or met.add(key))]
            if first:
                one = batch.take(pa.array(first))
                data, offsets = text_bytes(one.column(2))
                bits = [np.packbits(presence(data[a:b])).tobytes() for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([one.column(0), pa.array(bits, pa.binary()), one.column(1)],
                                                 ["__lang", "__bits", "__order"])

    taken = labelled.join(chosen, ["__lang", "__order"]).select("__lang", "__order", "__text")
    return taken.mapInArrow(packed, "__lang string, __bits binary, __order long").dropDuplicates(["__lang", "__order"])


def learned(docs: DataFrame, learn: Column, *, text: str = "text", lang: str = "lang",
            rows: int = ROWS_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE) -> Model | None:
    """The model of the labelled rows that `learn` admits; None if there are none."""
    bits, languages = [], []
    for row in sorted(training_rows(docs, learn, text, lang, rows).toLocalIterator(),
                      key=lambda r: (r["__order"], r["__lang"])):
        bits.append(np.frombuffer(row["__bits"], np.uint8))
        languages.append(row["__lang"])
    if not bits:
        return None
    names = sorted(set(languages))
    bits = np.array(bits)
    some = bits.any(axis=1)
    labels = np.searchsorted(names, languages)
    kept = sorted(set(labels[some].tolist()))
    if not kept:
        return None
    seen = np.unpackbits(bits[some], axis=1, count=SLOTS)
    return fit([names[k] for k in kept], seen, np.searchsorted(kept, labels[some]), landmarks)


def _predict(column: pa.Array, model: Model, batch: int = 128) -> list[dict]:
    out: list[dict] = []
    data, offsets = text_bytes(column)
    for low in range(0, len(column), batch):
        high = min(low + batch, len(column))
        texts = column.slice(low, batch).to_pylist()
        seen = np.zeros((high - low, len(model.slots)), np.uint8)
        sizes = np.zeros(high - low, np.int64)
        for i in range(low, high):
            flags = presence(data[offsets[i]:offsets[i + 1]])
            sizes[i - low] = np.count_nonzero(flags)
            seen[i - low] = flags[model.slots]
        values = model.values(seen, sizes)
        best, shares = values.argmax(axis=1), _scores(values).max(axis=1)
        for i in range(low, high):
            if texts[i - low] is None or not any(map(str.isalpha, texts[i - low])):
                out.append({"lang": UNKNOWN, "score": 0.0})
            else:
                out.append({"lang": model.languages[best[i - low]], "score": float(shares[i - low])})
    return out


_TYPE = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
_ARROW_TYPE = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def with_language(docs: DataFrame, model: Model | None, *, text: str = "text", out: str = "language") -> DataFrame:
    """`docs` plus a struct column `out`: the predicted language and a score between 0 and 1.

    The model is broadcast: a few MB, bounded by the landmarks. Texts are read whole, in place, and
    scored by matrix products in blocks of rows. A null text, one without any letter, and every text
    under no model gets `und` with score 0. A column named `out` is replaced; all others are kept.
    """
    if model is None:
        return docs.withColumn(out, F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_TYPE)
    def predict(column: pa.Array) -> pa.Array:
        return pa.array(_predict(column, shared.value), type=_ARROW_TYPE)

    return docs.withColumn(out, predict(F.col(text).cast("string")))
