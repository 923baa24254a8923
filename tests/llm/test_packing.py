import itertools
import random

import pytest

from gonggo.llm import packing
from gonggo.llm.queries import QUERIES

SIZES = (4, 8, 16)


def total(bins, cost=packing.Cost()):
    return sum(cost(s) for s, _ in bins)


def brute_best_fit(lengths, sizes, largest, cost):
    """Best fit by looking at every open bin."""
    bins = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        open_ = [(b["free"], k) for k, b in enumerate(bins) if b["free"] >= lengths[i]]
        if open_:
            k = min(open_)[1]
        else:
            bins.append({"free": packing.opening_size(lengths[i], sizes, largest, cost), "in": []})
            k = len(bins) - 1
        bins[k]["free"] -= lengths[i]
        bins[k]["in"].append(i)
    return [b["in"] for b in bins]


def test_best_fit_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.randrange(1, 17) for _ in range(rng.randrange(60))]
        for largest in SIZES:
            cost = packing.Cost(rng.random() * 5, 1, rng.random())
            assert packing.best_fit(lengths, SIZES, largest, cost) == brute_best_fit(lengths, SIZES, largest, cost)


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]]] + rest
        for k in range(len(rest)):
            yield rest[:k] + [[items[0]] + rest[k]] + rest[k + 1:]


def test_near_the_optimum():
    rng = random.Random(3)
    cost = packing.Cost(1, 1, 0.02)
    for _ in range(25):
        lengths = [rng.randrange(1, 17) for _ in range(7)]
        best = min(sum(cost(packing.smallest_size(sum(lengths[i] for i in b), SIZES)) for b in p)
                   for p in partitions(list(range(7))) if all(sum(lengths[i] for i in b) <= 16 for b in p))
        got = packing.pack(lengths, SIZES, cost)
        assert best - 1e-9 <= total(got, cost) <= 1.35 * best
        assert total(got, cost) <= min(total([(packing.smallest_size(sum(lengths[i] for i in b), SIZES), b)
                                              for b in brute_best_fit(lengths, SIZES, s, cost)], cost) for s in SIZES) + 1e-9


def whole(rows, docs, sizes, separator=1):
    """Every token of every row lies in exactly one piece, and every bin has its least size."""
    seen = {}
    for r in rows:
        assert r.used == sum(p.length for p in r.pieces) <= r.capacity and r.n_pieces == len(r.pieces)
        assert r.capacity == min(s for s in sizes if s >= r.used) and r.doc_ids == [p.doc_id for p in r.pieces]
        for p in r.pieces:
            seen.setdefault(p.doc_id, []).extend([(p.start, p.length)])
    want = {}
    for d, n in docs:
        n = max(n or 0, 0) + separator
        want.setdefault(d, []).extend([(s, min(max(sizes), n - s)) for s in range(0, n, max(sizes))])
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert len({r.bin_id for r in rows}) == len(rows)


def test_all_pieces_once(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice([None, 0, -3, 1, 5, 15, 16, 17, 100])) for i in range(300)] + [(None, 3), (7, 2), (7, 2), (8, 5000)]
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, n_tokens long, start string")
    for rows, separator in itertools.product((11, 50_000), (0, 1)):
        whole(packing.packed(df, sizes=SIZES, rows=rows, separator=separator).collect(), docs, SIZES, separator)
    assert packing.packed(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.packed(df, sizes=())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op3_packing"](spark, sf).collect()
    counts = QUERIES["op9_token_counts"](spark, sf).collect()
    whole(rows, [(r.doc_id, r.n_tokens) for r in counts], packing.CAPACITIES)
    assert sum(r.used for r in rows) / sum(r.capacity for r in rows) > 0.9
