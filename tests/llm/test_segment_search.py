import math
import random

import numpy as np
from pyspark.sql import functions as F

from gonggo.llm import segment_search as S

SCHEMA = "vec_id long, embedding array<double>, score string, slot int"


def brute(rows, k, scale=256):
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in whole:
        if q is None or q % 50:
            continue
        found = sorted((-max(-2**63 + 1, min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), c is None, c or 0)
                       for c, y in whole if c != q and len(x) == len(y))
        out += [(q, r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(found[:k])]
    return sorted(out, key=repr)


def check(spark, rows, k=5):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    out = S.top_k(frame, F.col("vec_id") % 50 == 0, k)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows, k)


def test_bounds_hold():
    rnd = np.random.default_rng(3)
    x, y = (np.floor(256 * rnd.normal(size=(40, 37)) + 30) for _ in range(2))
    exact, before = x @ y.T, np.inf
    for size in (37, 16, 4, 2):
        bound = S.statistics(x, size) @ S.statistics(y, size).T
        assert (bound >= exact - 1e-6).all() and bound.sum() <= before + 1e-6
        before = bound.sum()


def test_random_vectors(spark):
    rnd = random.Random(4)
    centers = [[rnd.gauss(0, .3) for _ in range(33)] for _ in range(4)]
    rows = [(i, [m + rnd.gauss(0, .05) for m in rnd.choice(centers)]) for i in range(300)]
    check(spark, rows)
    check(spark, rows, 1)


def test_pruning_keeps_only_survivors(spark, monkeypatch):
    monkeypatch.setattr(S, "DENSE_SHARE", 1.0)
    rnd = random.Random(8)
    check(spark, [(i, [rnd.gauss(0, 1) * (1 + i % 3) for _ in range(20)]) for i in range(200)])


def test_ties_copies_and_repeated_rows(spark):
    same, other = [.5, -.25, 1.0], [1.0, 1.0, 0.0]
    rows = [(i, same) for i in range(120)] + [(50, same)] * 3 + [(7, same)] * 9 + [(i, other) for i in range(200, 240)]
    check(spark, rows)


def test_nulls_lengths_and_large_values(spark):
    rows = [(0, [1.0, 2.0]), (0, None), (50, [1.0, None]), (50, [float("nan"), 1.0]), (50, [float("inf"), 1.0]),
            (None, [1.0, 2.0]), (None, [3.0, 2.0]), (3, [1.0, 2.0, 3.0]), (100, []), (4, []), (100, [5.0]), (5, [-5.0]),
            (150, [1e30, -1e30]), (6, [1e30, 1.0]), (7, [-1e30, 1.0]), (200, [3e7, 3e7]), (8, [3e7, -1.0]), (9, [3e7 + 1, 2.0])]
    check(spark, rows)


def test_empty(spark):
    check(spark, [])
    check(spark, [(1, [1.0]), (2, [2.0])])


def test_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_BYTES", 200)
    rnd = random.Random(2)
    check(spark, [(i * 10, [rnd.random() for _ in range(5)]) for i in range(60)])


def test_query(against_sql):
    against_sql("op12_segment_search")
