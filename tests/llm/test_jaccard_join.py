import random
import re

import numpy as np
from pyspark.sql import functions as F

from gonggo import session
from gonggo.llm import jaccard_join
from gonggo.llm.components import components
from gonggo.llm.jaccard_join import Rule


def grams(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(docs, rule):
    sets = [(d, grams(t, rule.n)) for d, t in docs]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i]
             if x and y and rule.den * len(x & y) >= rule.num * len(x | y)]
    least = roots([d for d, _ in sets], links)
    return {d: (len(s), least[d]) for d, s in sets}


def got(spark, docs, rule, parts=3, earlier=0):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "sid": F.lit("x")})
    rows = jaccard_join.jaccard_components(df.repartition(parts), rule, earlier=earlier).collect()
    assert len(rows) == len(docs)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_query(against_sql):
    rows = against_sql("op6_jaccard_join", "/root/testdata/sf0.01")
    assert (rows.component_id < rows.doc_id).sum() > 20


def near_copies(rng, key, groups):
    docs = []
    for _ in range(groups):
        base = [rng.choice(["the", "of", f"w{rng.randrange(3000)}"]) for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(1, 14)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(3000)}"
            if rng.random() < 0.2:
                words.insert(rng.randrange(len(words) + 1), "x")
            docs.append((key + len(docs), rng.choice([" ", "\n", "  "]).join(words).upper() if rng.random() < 0.3 else " ".join(words)))
    return docs


def test_against_brute_force(spark):
    rng = random.Random(7)
    docs = near_copies(rng, 0, 45)
    # One group where everything is near everything, and a line that most documents share.
    base = [f"v{i}" for i in range(40)]
    docs += [(5000 + i, " ".join(base[:i % 40] + [f"u{i}"] * (i % 3) + base[i % 40:])) for i in range(60)]
    docs += [(6000 + i, "this is a very common line of words " + " ".join(f"y{i}_{j}" for j in range(i % 9))) for i in range(40)]
    docs += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "One"), (9005, "one two"), (9006, "long " * 30000)]
    rng.shuffle(docs)
    for rule in (Rule(3, 90, 100), Rule(5, 80, 100)):
        assert got(spark, docs, rule) == brute(docs, rule)


def with_additions(rng, shares):
    """Pairs of a text and the same with some % rare words at its end or in its middle, over frequent n-grams.

    A third text makes the shared n-grams frequent; its own rare words keep them out of its prefix.
    """
    docs = []
    for group, share in enumerate(shares):
        base = [f"s{group}_{i}" for i in range(rng.randrange(100, 260))]
        extra = [f"r{group}_{i}" for i in range(len(base) * share // 100)]
        at = len(base) if group % 2 else len(base) // 2
        docs += [(3 * group, " ".join(base)), (3 * group + 1, " ".join(base[:at] + extra + base[at:])),
                 (3 * group + 2, " ".join(base * 40 + [f"f{group}_{i}" for i in range(len(base))]))]
    return docs


def test_added_rare_words(spark):
    """Rare words in one text's prefix push shared n-grams out of it; the pair still links."""
    for rule, shares in ((Rule(3, 90, 100), range(3, 11)), (Rule(5, 80, 100), range(3, 24))):
        docs = with_additions(random.Random(11), shares)
        want = brute(docs, rule)
        assert sum(want[d][1] < d for d in want) > 4
        assert got(spark, docs, rule) == want


def test_edges(spark):
    assert got(spark, [], Rule()) == {}
    assert got(spark, [(None, "a b c d"), (3, "a b c d"), (4, None)], Rule()) == {None: (2, 3), 3: (2, 3), 4: (0, 4)}
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "z"), (0, "a b c")], "doc_id long, text string")
    rows = jaccard_join.jaccard_components(twice).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, rows)) == [(0, 0), (1, 0), (1, 0), (1, 1)]


def test_very_many_null_ids(spark, monkeypatch):
    """Texts without an id are told apart by their hash; repeated rows are read once."""
    rng, docs = random.Random(21), []
    for i in range(350):
        base = [f"g{i}_{j}" if rng.random() < 0.7 else "the" for j in range(rng.randrange(30, 60))]
        docs.append((i, " ".join(base)))
        for k in range(3):
            docs.append((10 ** 6 + len(docs), " ".join([f"k{i}_{k}", *base] if k else base + base[:1])))
        docs += [(10 ** 6 + len(docs) + k, docs[-1][1]) for k in range(1, rng.randrange(1, 4))]
    want = brute(docs, Rule())
    assert sum(want[d][1] < d for d in want) > 900
    null = [(None if d >= 10 ** 6 else d, t) for d, t in docs]
    sizes, linked = [], jaccard_join.verified

    def seen(pairs, stage, read, rule, **how):
        out = linked(pairs, stage, read, rule, **how)
        sizes.append((pairs.distinct().count(), out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "verified", seen)
    rows = jaccard_join.jaccard_components(spark.createDataFrame(null, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id) for r in rows])) == sorted(
        map(str, [(None if d >= 10 ** 6 else d, *want[d]) for d in want]))
    assert all(found <= asked for asked, found in sizes)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    sets = [rng.choice(300, rng.integers(0, 80), replace=False).astype(np.uint64) for _ in range(30)]
    odd = jaccard_join.parity_sketches(np.concatenate(sets), np.array([len(s) for s in sets])).view(np.uint8)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert np.unpackbits(odd[i] ^ odd[j]).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 3), (7, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    real = [(a, b) for a, b in links if a != b]
    want = roots({n for link in real for n in link}, real)
    assert {r.node: r.root for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_sets_are_read_once(spark, monkeypatch):
    """Texts to verify go through one Python step, which no filter on its result repeats."""
    docs = [(i, f"one two three four five six seven eight nine ten eleven {i % 3}") for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    steps, write = [], jaccard_join.written

    def seen(frame, name="stage"):
        if name == "sets":
            plan = frame._jdf.queryExecution().optimizedPlan().toString()
            steps.append(plan.count("sets("))
        return write(frame, name)

    monkeypatch.setattr(jaccard_join, "written", seen)
    rows = jaccard_join.jaccard_components(df, Rule(num=80)).collect()
    assert set(steps) == {1} and {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs, Rule(num=80))


def test_postings_hold_one_step_of_shuffles(spark, monkeypatch):
    """Each step of the postings is written by itself, and its inputs are files, not the shuffles of the step before."""
    docs = [(i, f"one two three four five six seven eight nine ten eleven {i % 3}") for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    stage, shuffles, write = jaccard_join.prefixes(df, Rule()), [], session.written

    def seen(frame, name="stage"):
        shuffles.append(frame._jdf.queryExecution().sparkPlan().toString())
        return write(frame, name)

    for module in (jaccard_join, session):
        monkeypatch.setattr(module, "written", seen)
    rows = jaccard_join.postings(stage).collect()
    assert len(rows) == len({(r.token, r.sid) for r in rows}) > 0
    assert [sum(step in plan for step in ("send(", "FlatMapCoGroups", "HashAggregate")) for plan in shuffles] == [1, 1, 1]


def test_pairs_of_a_shared_passage_are_made_about_once(spark):
    """Before, each n-gram of the passage made a row for each pair."""
    rng, rule = random.Random(11), Rule(5, 80, 100)
    shared = [1000 + i for i in range(30)]
    sets, rows = {}, []
    for sid in range(40):
        # All of the passage, or most of it, among n-grams that no other set has; some sets are connected already.
        own = [(-1) ** i * (10_000 * (sid + 1) + i) for i in range(20)]
        sets[sid] = sorted(rng.sample(shared, rng.randrange(20, 31)) + own)
        rows += [(token, sid, 200, 8, pos, sid // 2) for pos, token in enumerate(sets[sid])]
    odd = [0] * jaccard_join.SKETCH_WORDS
    holders = {}
    for token, _, _, _, _, comp in rows:
        holders.setdefault(token, []).append(comp)
    rows = [(*r, max(sorted(set(holders[r[0]])), key=holders[r[0]].count), odd) for r in rows if len(set(holders[r[0]])) > 1]
    table = spark.createDataFrame(rows, "token long, sid long, n long, ell int, pos int, comp long, major long, odd array<long>")
    found = [tuple(sorted((r.sid_x, r.sid_y))) for r in jaccard_join.pairs_between(jaccard_join.with_earlier(table), rule).collect()]
    last = 200 - rule.num * 400 // (rule.num + rule.den) - 1
    expected = {(a, b) for b in sets for a in range(b) if a // 2 != b // 2
                and any(sets[a].index(t) <= last and sets[b].index(t) <= last for t in set(sets[a]) & set(sets[b]))}
    assert set(found) == expected and len(expected) > 500
    assert len(found) < 2 * len(expected)


def test_passages_of_unlike_texts_against_brute_force(spark):
    """Texts that share rare passages link by what else they share, whatever components they begin in."""
    rng, docs = random.Random(12), []
    for group in range(6):
        passage = [f"p{group}x{i}" for i in range(40)]
        base = [f"b{group}x{i}" for i in range(160)]
        for _ in range(20):
            words = list(base)
            for at in rng.sample(range(160), rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8])):
                words[at] = f"w{rng.randrange(10**6)}"
            at = rng.randrange(0, 160)
            docs.append((len(docs), " ".join(words[:at] + passage + words[at:] if rng.random() < 0.7 else words)))
    for rule in (Rule(5, 80, 100), Rule(3, 90, 100)):
        expected = brute(docs, rule)
        assert got(spark, docs, rule, earlier=jaccard_join.EARLIER) == expected
        assert 6 < len({c for _, c in expected.values()}) < len(docs)


def test_sketches_stay_where_they_tell_sets_apart(spark):
    table = spark.createDataFrame([(100, [1] * 8), (1449, [1] * 8), (3000, [1] * 8)], "n long, odd array<long>")
    kept = [[r.odd is not None for r in table.select(jaccard_join._useful_sketch(rule)).collect()]
            for rule in (Rule(5, 80, 100), Rule(3, 90, 100))]
    assert kept == [[True, True, False], [True, True, False]]
