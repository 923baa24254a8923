"""Toxicity by a classifier chain of linear models.

Each category has a logistic model over the words of a text and over what the models of the categories
before it say. In training, that is what models that have not seen the row say (out of fold); else
the later models would trust the earlier ones more than they can when it counts.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gonggo.llm import bytetext
from gonggo.llm.names import fresh
from gonggo.session import lookup

# Bound of the fit: labelled rows that are learned from, chosen by a hash of their id.
TRAINING_ROWS = 20_000
FOLDS, SLOT_BITS = 3, 20
BEGINNINGS = range(4, 9)
# Words of fewer training rows are not learned, nor those whose share of a category is within so many
# standard deviations of that of all rows.
LEAST_ROWS, DEVIATIONS = 3, 3.0
# Weak enough for the few words that tell, with the many that do not held near 0.
PENALTY = 3e-4
_FAR = 6.0


@dataclass
class Words:
    """The distinct hashed words of some texts: slots of all rows, end to end, and where each row begins."""

    slots: np.ndarray
    begin: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.begin) - 1

    def take(self, rows: np.ndarray) -> Words:
        sizes = np.diff(self.begin)[rows]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(begin[-1]) - np.repeat(begin[:-1], sizes) + np.repeat(self.begin[:-1][rows], sizes)
        return Words(self.slots[at], begin)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Each row's sum of its words' weights."""
        total = np.concatenate([[0.0], np.cumsum(weights[self.slots], dtype=np.float64)])
        return total[self.begin[1:]] - total[self.begin[:-1]]


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words and their beginnings of 4 to 8 bytes.

    Words are runs of ASCII letters and digits and of all code points beyond, A-Z lower-cased.
    Beginnings stand for words that differ in their endings alone.
    """
    table = bytetext.LETTER_WORDS
    starts, ends, rows = bytetext.words(data, offsets, table)
    hashes = bytetext.word_hashes(data, starts, ends, table)
    order = np.lexsort((hashes, rows))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    once = order[new]
    starts, ends, rows = starts[once], ends[once], rows[once].astype(np.int64)
    found, where = [hashes[once]], [rows]
    for length, factor in zip(BEGINNINGS, bytetext.odd_numbers(len(BEGINNINGS), 500)):
        longer = ends - starts > length
        at = starts[longer]
        found.append(bytetext.mix(bytetext.word_hashes(data, at, at + length, table) * factor))
        where.append(rows[longer])
    slots = (np.concatenate(found) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    keys = np.unique(np.concatenate(where) << SLOT_BITS | slots)
    counts = np.bincount(keys >> SLOT_BITS, minlength=len(offsets) - 1)
    return Words((keys & (1 << SLOT_BITS) - 1).astype(np.int32), np.concatenate([[0], np.cumsum(counts)]))


def _sure(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    """log-odds, held to a range so that a sure model is no outlier."""
    return np.clip(np.log(np.maximum(p, 1e-9) / np.maximum(1 - p, 1e-9)), -_FAR, _FAR)


@dataclass
class Link:
    """One category's model: word weights, weights of the earlier categories' log-odds, and an offset."""

    category: str
    words: np.ndarray
    before: np.ndarray
    offset: float
    threshold: float = 0.5

    def probability(self, words: Words, earlier: np.ndarray) -> np.ndarray:
        return _sure(words.sums(self.words) + earlier @ self.before + self.offset)


def telling(words: Words, row: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Slots whose rows differ from all rows in their share of the category by more than chance explains."""
    rows = np.bincount(words.slots, minlength=1 << SLOT_BITS)
    positive = np.bincount(words.slots, labels[row], minlength=1 << SLOT_BITS)
    share = labels.mean()
    return (rows >= LEAST_ROWS) & (np.abs(positive - rows * share) > DEVIATIONS * np.sqrt(rows * share * (1 - share)))


def fit_link(category: str, words: Words, earlier: np.ndarray, labels: np.ndarray,
             penalty: float = PENALTY, steps: int = 80) -> Link:
    """Logistic regression with a squared penalty, by limited-memory quasi-Newton steps."""
    if not len(labels) or labels.min() == labels.max():
        sure = 30.0 if len(labels) and labels[0] else -30.0
        return Link(category, np.zeros(1 << SLOT_BITS, np.float32), np.zeros(earlier.shape[1]), sure)
    row = np.repeat(np.arange(words.rows), np.diff(words.begin))
    common = telling(words, row, labels)
    used, keep = np.flatnonzero(common), common[words.slots]
    compact, row = (np.cumsum(common) - 1)[words.slots[keep]], row[keep]
    n, k = len(used), earlier.shape[1]
    small = Words(compact, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=words.rows))]))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        x = small.sums(w[:n]) + earlier @ w[n:n + k] + w[-1]
        miss = _sure(x) - labels
        value = np.mean(np.logaddexp(0, x) - labels * x) + penalty / 2 * (w[:-1] @ w[:-1])
        slope = np.concatenate([np.bincount(compact, miss[row], minlength=n), earlier.T @ miss, [miss.sum()]]) / len(labels)
        slope[:-1] += penalty * w[:-1]
        return value, slope

    w = np.zeros(n + k + 1)
    value, slope = loss(w)
    past: deque = deque(maxlen=8)
    for _ in range(steps):
        step, kept = -slope, []
        for s, y, r in reversed(past):
            a = r * (s @ step)
            step = step - a * y
            kept.append(a)
        if past:
            s, y, r = past[-1]
            step *= 1 / (r * (y @ y))
        for (s, y, r), a in zip(past, reversed(kept)):
            step = step + (a - r * (y @ step)) * s
        size, gain = 1.0, slope @ step
        while True:
            there = w + size * step
            value_there, slope_there = loss(there)
            if value_there <= value + 1e-4 * size * gain or size < 1e-6:
                break
            size /= 2
        s, y = there - w, slope_there - slope
        if s @ y > 1e-12:
            past.append((s, y, 1 / (s @ y)))
        done = value - value_there < 1e-7
        w, value, slope = there, value_there, slope_there
        if done:
            break
    weights = np.zeros(1 << SLOT_BITS, np.float32)
    weights[used] = w[:n]
    return Link(category, weights, w[n:n + k], float(w[-1]))


def best_threshold(p: np.ndarray, labels: np.ndarray) -> float:
    """The threshold, in hundredths, with the best F1; of equals, the middle one of the widest run."""
    scores = []
    for t in range(1, 100):
        said = p >= t / 100
        both = said.sum() + labels.sum()
        scores.append(2 * (said & (labels > 0)).sum() / both if both else 0.0)
    best = np.flatnonzero(np.array(scores) == max(scores))
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    widest = max(runs, key=len)
    return (widest[len(widest) // 2] + 1) / 100


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def probabilities(self, words: Words) -> np.ndarray:
        """rows x categories: each model sees the probabilities of those before it."""
        earlier = np.zeros((words.rows, 0))
        out = []
        for link in self.links:
            out.append(link.probability(words, earlier))
            earlier = np.column_stack([earlier, logit(out[-1])])
        return np.column_stack(out)

    def predict(self, docs: DataFrame, *, text: str = "text") -> DataFrame:
        """`docs` plus p_<category> (0 to 1) and is_<category> for each category of the chain.

        Every text is scored whole, in place, without a shuffle; the models are 4 MB a category. A null
        text counts as empty; a text without words gets what the offsets say. Columns of these
        names are replaced; all others are kept.
        """
        shared = docs.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def score(column: pa.Array) -> pa.Array:
            data, offsets = bytetext.text_bytes(column)
            parts = [shared.value.probabilities(read_words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]))
                     for a, b in bytetext.slices(offsets)]
            return pa.array([row.tolist() for part in parts for row in part], pa.list_(pa.float64()))

        scores, = fresh(docs, "scores")
        out = docs.withColumn(scores, score(F.col(text).cast("string")))
        for i, link in enumerate(self.links):
            out = out.withColumn(f"p_{link.category}", F.col(scores)[i]).withColumn(
                f"is_{link.category}", F.col(scores)[i] >= link.threshold)
        return out.drop(scores)


def learn(words: Words, labels: np.ndarray, categories: Sequence[str], folds: np.ndarray) -> Chain:
    """One model of all rows per category, and one for each fold left out."""
    chain, earlier = Chain(), np.zeros((words.rows, 0))
    for j, category in enumerate(categories):
        unseen = np.zeros(words.rows)
        for fold in np.unique(folds):
            rest, own = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
            model = fit_link(category, words.take(rest), earlier[rest], labels[rest, j])
            unseen[own] = model.probability(words.take(own), earlier[own])
        link = fit_link(category, words, earlier, labels[:, j])
        if words.rows:
            link.threshold = best_threshold(unseen, labels[:, j])
        chain.links.append(link)
        earlier = np.column_stack([earlier, logit(unseen)])
    return chain


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], *, text: str = "text",
              doc_id: str = "doc_id", rows: int = TRAINING_ROWS, folds: int = FOLDS) -> Chain:
    """A chain over the 0/1 columns `categories` of `labels`, in their order.

    Learns from about `rows` labelled documents, chosen by a hash of the id; a larger label table changes
    the choice, not the cost. Their texts are read whole, in tasks, and only their distinct hashed words
    come to the driver. Labels that are null, and those of unknown documents, are left out; repeated labels
    count as often as they occur. Without any label, the probability is 0 throughout; where all labels
    are equal, it is theirs.
    """
    known = labels.dropna(subset=[doc_id, *categories])
    share = min(1.0, rows / max(known.count(), 1))
    chosen = lookup(known.where(F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) < int(share * 1_000_000)).select(
        F.col(doc_id).alias("__id"), *[F.col(c).cast("double").alias(f"__label{i}") for i, c in enumerate(categories)]))

    @F.arrow_udf(T.BinaryType())
    def slots(column: pa.Array) -> pa.Array:
        data, offsets = bytetext.text_bytes(column)
        return pa.array([read_words(data[a:b], np.array([0, b - a])).slots.tobytes()
                         for a, b in zip(offsets, offsets[1:])], pa.binary())

    names = [f"__label{i}" for i in range(len(categories))]
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text"))
    taken = texts.join(chosen, "__id").select(
        F.xxhash64("__id", F.lit(1)).alias("__order"), F.array(*names).alias("__labels"), slots("__text").alias("__slots"))
    found = sorted(((r["__order"], r["__labels"], r["__slots"]) for r in taken.toLocalIterator()))
    words = [np.frombuffer(r[2], np.int32) for r in found]
    begin = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    packed = Words(np.concatenate(words) if words else np.zeros(0, np.int32), begin)
    values = np.array([r[1] for r in found]).reshape(len(found), len(categories))
    return learn(packed, values, categories, np.array([r[0] for r in found], np.int64) % folds)
