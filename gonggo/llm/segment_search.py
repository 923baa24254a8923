"""Exact top-k search by inner product, pruned by segment statistics of several resolutions.

A vector is cut into segments. By their means and deviations, two vectors are at least
sum(len * ((mean_q - mean_x)**2 + (dev_q - dev_x)**2)) apart (squared). Since the statistics also give the
lengths of both, this bounds their inner product from above:
sum(len * (mean_q * mean_x + dev_q * dev_x)). Few segments are looked at first, then more, and whole
vectors only where the bound still reaches the query's k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gonggo.llm.names import fresh
from gonggo.session import arrow_rows, written

# Queries that are broadcast together: the bytes of their vectors.
CHUNK_BYTES = 16 << 20
# Components in a segment, coarse to fine.
RESOLUTIONS = (16, 4, 2)
# Queries and candidates that meet at a time, and candidates of one Arrow batch.
QUERY_ROWS, MEET_ROWS, BATCH_ROWS = 512, 2048, 4096
# Bounds that leave more than this share of pairs are followed by one matrix product.
DENSE_SHARE = 0.3
NO_ID = np.iinfo(np.int64).max
LOWEST = np.iinfo(np.int64).min
_EXACT = 2.0 ** 53

_FOUND = "slot int, query_id long, vec_id long, score long"


def statistics(x: np.ndarray, segment: int) -> np.ndarray:
    """For each row: the mean and the deviation of each segment, both times the root of its length."""
    start = np.arange(0, x.shape[1], segment)
    length = np.diff(np.append(start, x.shape[1]))
    mean = np.add.reduceat(x, start, axis=1) / length
    off = x - np.repeat(mean, length, axis=1)
    return np.concatenate([mean * np.sqrt(length), np.sqrt(np.add.reduceat(off * off, start, axis=1))], axis=1)


def _place(*keys: np.ndarray) -> np.ndarray:
    """Each row's place, from 0, among the adjacent rows of the same keys."""
    n = len(keys[0])
    begin = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
    return np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))


class Queries:
    """Some queries of one length and the best candidates that they have met so far."""

    def __init__(self, slots: np.ndarray, ids: np.ndarray, x: np.ndarray, least: np.ndarray, k: int):
        self.slots, self.ids, self.x, self.least, self.k = slots, ids, x, least, k
        self.score = np.full((len(ids), k), LOWEST)
        self.found = np.full((len(ids), k), NO_ID)
        self.sizes = [s for s in RESOLUTIONS if s < x.shape[1]]
        self.coarse = [statistics(x, s) for s in self.sizes]
        self.norm = np.sqrt((x * x).sum(axis=1))

    def meet(self, ids: np.ndarray, c: np.ndarray) -> None:
        """Candidates come in growing portions, so that most meet queries that have scores to beat."""
        low, size = 0, 4 * self.k
        while low < len(ids):
            part = slice(low, low + size)
            own, rows = self._distinct(ids[part], c[part])
            stats, norm = [statistics(rows, s) for s in self.sizes], np.sqrt((rows * rows).sum(axis=1))
            for q in range(0, len(self.ids), QUERY_ROWS):
                self._meet(slice(q, q + QUERY_ROWS), own, rows, stats, norm)
            low, size = low + size, min(4 * size, MEET_ROWS)

    def _distinct(self, ids: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of equal vectors, the smallest ids that any query can need: k of one id, 2 k in all."""
        order = np.lexsort((ids, *c.T))
        ids, c = ids[order], c[order]
        vector = np.cumsum(np.append(True, (c[1:] != c[:-1]).any(axis=1)))
        few = _place(vector, ids) < self.k
        ids, c, vector = ids[few], c[few], vector[few]
        few = _place(vector) < 2 * self.k
        return ids[few], c[few]

    def _scores(self, x: np.ndarray, c: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Inner products as integers, held within 64 bits; of all pairs, or of the given ones."""
        most = np.abs(x).max(initial=0) * np.abs(c).max(initial=0) * max(x.shape[1], 1)
        if most < _EXACT:
            out = x @ c.T if pairs is None else np.einsum("ij,ij->i", x[pairs[0]], c[pairs[1]])
            return out.astype(np.int64)
        whole, other = ([[int(v) for v in row] for row in m] for m in (x, c))
        pairs = pairs or np.divmod(np.arange(len(x) * len(c)), len(c))
        out = [max(LOWEST + 1, min(NO_ID, sum(a * b for a, b in zip(whole[i], other[j])))) for i, j in zip(*pairs)]
        return np.array(out, np.int64).reshape((len(x), len(c)) if len(out) == len(x) * len(c) else -1)

    def _meet(self, rows: slice, ids: np.ndarray, c: np.ndarray, stats: list[np.ndarray], norm: np.ndarray) -> None:
        floor = np.maximum(self.least[rows], self.score[rows, -1])
        x, pairs = self.x[rows], None
        slack = 1e-9 * self.norm[rows][:, None] * norm[None, :] + 1e-6
        for mine, theirs in zip(self.coarse, stats):
            mine = mine[rows]
            if pairs is None:
                near = mine @ theirs.T + slack >= floor[:, None]
                if near.mean() <= DENSE_SHARE:
                    pairs = np.nonzero(near)
            else:
                near = np.einsum("ij,ij->i", mine[pairs[0]], theirs[pairs[1]]) + slack[pairs] >= floor[pairs[0]]
                pairs = pairs[0][near], pairs[1][near]
        if pairs is None:
            scores = self._scores(x, c)
            pairs = np.nonzero(scores >= floor[:, None])
            scores = scores[pairs]
        else:
            scores = self._scores(x, c, pairs).ravel()
        q, at = pairs
        keep = (scores >= floor[q]) & (ids[at] != self.ids[rows][q])
        if not keep.any():
            return
        q, scores, found = q[keep] + rows.start, scores[keep], ids[at[keep]]
        some = np.unique(q)
        q = np.concatenate([np.repeat(some, self.k), q])
        scores = np.concatenate([self.score[some].ravel(), scores])
        found = np.concatenate([self.found[some].ravel(), found])
        order = np.lexsort((found, ~scores, q))
        q, scores, found = q[order], scores[order], found[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        best = first[:, None] + np.arange(self.k)
        self.score[some], self.found[some] = scores[best], found[best]

    def result(self) -> pa.RecordBatch:
        met = (self.score > LOWEST) & (self.score >= self.least[:, None])
        q, _ = np.nonzero(met)
        found = self.found[met]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.slots[q].astype(np.int32)), pa.array(self.ids[q]), pa.array(found, mask=found == NO_ID),
             pa.array(self.score[met])], ["slot", "query_id", "vec_id", "score"])


def _by_length(ids: pa.Array, vectors: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, ids and scaled vectors of all rows of one length, for each length."""
    ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    begin = vectors.offsets.to_numpy()[:-1] - vectors.offsets[0].as_py()
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * scale)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, ids[rows], values[begin[rows][:, None] + np.arange(size)].reshape(len(rows), size)


def _scanned(candidates: DataFrame, queries: pa.Table, least: np.ndarray, k: int, scale: float) -> DataFrame:
    """Each query's `k` best of each task's candidates, as far as they reach the query's least score."""
    ids, vectors = (queries[n].combine_chunks() for n in ("id", "vec"))
    groups = [(rows, own, x, least[rows]) for rows, own, x in _by_length(ids, vectors, scale)]
    shared = candidates.sparkSession.sparkContext.broadcast(groups)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {g[2].shape[1]: Queries(*g, k) for g in shared.value}
        for batch in batches:
            for _, own, c in _by_length(batch.column(0), batch.column(1), scale):
                if c.shape[1] in sets:
                    sets[c.shape[1]].meet(own, c)
        for s in sets.values():
            yield s.result()

    best = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return candidates.mapInArrow(scan, _FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, scale: float = 256.0, vec_id: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` rows with the largest inner product for each query row.

    Components become floor(scale * x). A query's candidates are all rows with another id and a vector of
    the same length; of equal scores the smaller vec_id comes first, a null id last. Every row that meets
    `is_query` is a query and every row is a candidate, so repeated rows are answered, and found, as often
    as they are there. Rows whose vector is null, or holds a null, NaN or infinity, take no part; a query
    without an id is none, an empty table gives no rows, and other columns are left out. Scores beyond 64
    bits are held at their limits. The id 2**63 - 1 is read as null.

    Queries go out in chunks of `CHUNK_BYTES` of vectors (one vector at least), one scan of all rows a chunk. First the
    chunk meets the other queries, whose k-th score every query's real one reaches; with that to beat,
    the scan hands on few rows. A task holds the chunk, its best rows, and one batch.
    """
    spark = vectors.sparkSession
    ident, vec, asked = fresh(vectors, "id", "vec", "asked")
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = (vectors.select(F.col(vec_id).cast("bigint").alias(ident), F.col(vector).cast("array<double>").alias(vec),
                           F.coalesce(is_query, F.lit(False)).alias(asked))
            .where(F.col(vec).isNotNull()).where(whole))
    candidates = rows.select(F.col(ident).alias("id"), F.col(vec).alias("vec"))
    with arrow_rows(spark, BATCH_ROWS):
        queries = written(rows.where(F.col(asked) & F.col(ident).isNotNull()).select(
            F.col(ident).alias("id"), F.col(vec).alias("vec")), "queries")
        total = queries.agg(F.sum(F.size("vec") * 8 + 16)).first()[0] or 0
        chunks = max(1, -(-total // CHUNK_BYTES))
        parts = []
        for i in range(chunks):
            chunk = queries.where(F.pmod(F.xxhash64("id", "vec"), F.lit(chunks)) == i).toArrow()
            if not chunk.num_rows and i:
                continue
            least = np.full(chunk.num_rows, LOWEST)
            for r in _scanned(queries, chunk, least, k, scale).where(F.col("rank") == k).select("slot", "score").collect():
                least[r.slot] = r.score
            part = _scanned(candidates, chunk, least, k, scale).select("query_id", "rank", "vec_id", "score")
            parts.append(written(part, "nearest"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
