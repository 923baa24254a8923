"""Matching against brute force, with hot skills, copies and repeated keys."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gonggo.operators import matching as M
from gonggo.operators import proxy as X
from gonggo.operators import trends as D

TECHS = list("ABCDEFGHIJ")


def make(spark, seed=1, rows=240):
    """A third of the rows are copies of one skill set, a third share one job_id."""
    rng = random.Random(seed)
    pool = []
    for i in range(rows):
        techs = ["A", "B"] if i % 3 == 0 else sorted(rng.sample(TECHS, rng.randint(0, 5)))
        if techs and rng.random() < 0.5:
            techs = sorted(set(techs) | {"A"})
        job = "hot" if i % 3 == 1 else f"j{rng.randint(0, rows)}"
        pool.append((i, job, techs, rng.choice([None, "", "서울", "부산"])))
    queries = [(q, sorted(rng.sample(TECHS, rng.randint(1, 4))), rng.choice([None, "서울"])) for q in range(12)]
    idf = {t: round(math.log(10 / (i + 1)), 12) for i, t in enumerate(TECHS[:8])}
    frames = (spark.createDataFrame(pool, "row_id long, job_id string, techs array<string>, location string"),
              spark.createDataFrame(queries, "query_id long, techs array<string>, want_location string"),
              spark.createDataFrame(list(idf.items()), "tech string, idf double")
              .withColumn("idf", F.col("idf").cast("decimal(18,12)")))
    return pool, queries, idf, frames


def brute(pool, queries, idf, mode, k, by_job, filtered=False):
    def w(ts, p=1):
        return sum(idf.get(t, 0.0) ** p for t in ts)
    out = {}
    for q, mine, want in queries:
        mine, best = set(mine), {}
        for row, job, techs, place in pool:
            hit = mine & set(techs)
            if not hit or (filtered and want and place and want != place):
                continue
            root = {"raw_idf": 1, "none": 1, "length_norm": math.sqrt(w(techs)) or 1, "sqrt": math.sqrt(w(techs)) or 1,
                    "linear": w(techs) or 1, "per_skill_count": len(techs), "count": len(techs)}
            if mode in root:
                s = w(hit) / root[mode]
            elif mode == "cosine":
                s = w(hit, 2) / ((math.sqrt(w(mine, 2)) or 1) * (math.sqrt(w(techs, 2)) or 1))
            elif mode == "jaccard" and by_job:
                s = len(hit) / len(mine | set(techs))
            else:
                u = w(techs) + w(mine) - w(hit)
                s = w(hit) / u if u > 0 else 0.0
            key = job if by_job else row
            best[key] = max(best.get(key, -1), round(s, 9))
        out[q] = sorted(((-s, e) for e, s in best.items()))[:k]
    return out


def spark_result(df, entity):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-round(r["score"], 9), r[entity]))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_product_matcher_equals_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(M, "LOOKUP_BYTES", 0)
    pool, queries, idf, (p, q, w) = make(spark)
    modes = list(M.SCORERS)
    got = M.top_matches_by_scheme(q, p, w, 5, modes).cache()
    for mode in modes:
        want = {k: v for k, v in brute(pool, queries, idf, mode, 5, True).items() if v}
        assert spark_result(got.where(F.col("scheme") == mode), "job_id") == want, mode


def test_baseline_schemes_equal_brute_force(spark):
    pool, queries, idf, (p, q, w) = make(spark, 2)
    got = M.top_matches_by_scheme(q, p, w, 7, list(M.SCHEMES), M.SCHEMES, "row_id", True).cache()
    for mode in M.SCHEMES:
        want = {k: v for k, v in brute(pool, queries, idf, mode, 7, False).items() if v}
        assert spark_result(got.where(F.col("scheme") == mode), "row_id") == want, mode


def test_few_seeds_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(M, "SEED_PROFILES", 5)
    pool, queries, idf, (p, q, w) = make(spark, 7)
    for mode in M.SCORERS:
        want = {k: v for k, v in brute(pool, queries, idf, mode, 3, True).items() if v}
        assert spark_result(M.top_matches(q, p, w, 3, mode), "job_id") == want, mode


def test_no_bound_lies_below_a_score():
    """Every score grows with what is shared, so the score of the most that can be shared bounds it."""
    rng = random.Random(3)
    for _ in range(300):
        mine, job = ({t: rng.choice([0, .3, 1.2, 2.5]) for t in rng.sample(TECHS, rng.randint(1, 6))} for _ in range(2))
        job = {t: mine.get(t, w) for t, w in job.items()}
        sums = [(sum(side.values()), sum(w * w for w in side.values()), len(side)) for side in (mine, job)]
        hit = {t: w for t, w in mine.items() if t in job}
        shared = (sum(hit.values()), sum(w * w for w in hit.values()), len(hit))
        most = tuple(min(a, b) for a, b in zip(*sums))

        def scores(h):
            (m, m2, mn), (j, j2, jn) = sums
            return (h[0], h[0] / (math.sqrt(j) or 1), h[2] / (mn + jn - h[2]), h[1] / ((math.sqrt(m2) or 1) * (math.sqrt(j2) or 1)),
                    h[0] / jn, h[0] / (j or 1), h[0] / (j + m - h[0]) if j + m > h[0] else 0)
        assert all(a <= b + 1e-12 for a, b in zip(scores(shared)[:6], scores(most)[:6]))


def test_equal_scores_show_the_first_posting(spark):
    p = spark.createDataFrame([(3, "same", ["A", "X"], None), (2, "same", ["B", "X"], None), (5, "other", ["A"], None)],
                              "row_id long, job_id string, techs array<string>, location string")
    q = spark.createDataFrame([(1, ["A", "B"])], "query_id long, techs array<string>")
    w = spark.createDataFrame([("A", 1.0), ("B", 1.0), ("X", 3.0)], "tech string, idf double").withColumn("idf", F.col("idf").cast("decimal(18,12)"))
    got = {r["job_id"]: r["matched_techs"] for r in M.top_matches(q, p, w).collect()}
    assert got == {"same": ["B"], "other": ["A"]}


def test_recommend(spark):
    rows = [(i, f"j{i}", "wanted", f"title {i}", "company", "서울" if i % 2 else None, None, techs, extra, text)
            for i, (techs, extra, text) in enumerate([
                (["Python"], [], "python api"), (["Python", "Django"], ["엑셀"], "django server"), (["Java"], [], "java spring"),
                (["Spring"], [], "spring boot"), ([], ["엑셀"], "office work"), ([], [], "plain words here")] * 6)]
    corpus = spark.createDataFrame(rows, """row_id long, job_id string, source string, title string, company string, location string,
        experience_level string, techs array<string>, skills_extra array<string>, raw_text string""").cache()
    asks = spark.createDataFrame([(1, "python", "서울"), (2, "Spring Boot", None), (3, "plain words", None), (4, None, None)],
                                 "query_id long, resume_text string, want_location string")

    def run(**how):
        out = {}
        for r in M.recommend(asks, corpus, "2026-06-20", 4, **how).orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append((r["job_id"], r["fallback"]))
        return out
    plain = run()
    assert set(plain) == {1} and [j for j, _ in plain[1]] == ["j0", "j12", "j18", "j24"]
    assert [j for j, _ in run(filters=("location",))[1]] == ["j0", "j12", "j18", "j24"]
    every = run(flags=M.Flags(True, True, True, True))
    assert [j for j, _ in every[2]] == ["j15", "j21", "j27", "j3"] and 4 not in every
    assert every[3] == [(j, "text_overlap") for j in ("j11", "j17", "j23", "j29")]
    with pytest.raises(ValueError):
        M.recommend(asks, corpus, "2026-06-20", mode="nope")


def test_filters_pass_missing_values(spark):
    pool, queries, idf, (p, q, w) = make(spark, 3)
    got = spark_result(M.top_matches(q, p, w, 6, filters=("location",)), "job_id")
    assert got == {k: v for k, v in brute(pool, queries, idf, "length_norm", 6, True, True).items() if v}


def test_postings_without_skills_change_nothing(spark):
    _, _, _, (p, q, w) = make(spark, 4)
    some = p.where(F.size("techs") > 0)
    assert spark_result(M.top_matches(q, p, w), "job_id") == spark_result(M.top_matches(q, some, w), "job_id")


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        M.scorer("nope")


def test_text_matches_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["spark", "데이터", "go", "api", "x", "서버", "db2"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(80)]
    rows = [(f"j{i % 70}", t) for i, t in enumerate(texts)]
    asks = [(i, " ".join(rng.sample(words, 3))) for i in range(5)]

    def toks(t):
        return {w.lower() for w in t.split() if len(w) >= 2}
    want = {}
    for q, t in asks:
        best = {}
        for j, text in rows:
            a, b = toks(t), toks(text)
            if a & b:
                best[j] = max(best.get(j, 0), round(len(a & b) / len(a | b), 9))
        if best:
            want[q] = sorted((-s, j) for j, s in best.items())[:4]
    got = M.text_matches(spark.createDataFrame(asks, "query_id long, resume_text string"),
                         spark.createDataFrame(rows, "job_id string, raw_text string"), 4)
    assert spark_result(got, "job_id") == want


def test_extras_and_related(spark):
    vocabulary = spark.createDataFrame([("엑셀",), ("c",), ("ms office",), ("회계",)], "skill string")
    asks = spark.createDataFrame([(1, "MS Office와 엑셀"), (2, "회"), (3, None), (4, "abc")], "query_id long, resume_text string")
    got = {r["query_id"]: r["techs"] for r in M.extras_in_text(asks, vocabulary).collect()}
    assert got == {1: ["c", "ms office", "엑셀"], 4: ["c"]}
    sets = spark.createDataFrame([(1, ["A", "B"]), (2, ["A", "B", "C"]), (3, ["A"])], "row_id long, techs array<string>")
    pairs = D.cooccurrence(sets, D.universe_of(sets))
    assert {(r["base"], r["tech"], r["n"], r["match_count"]) for r in pairs.collect()} >= {
        ("A", "B", 2, 3), ("B", "A", 2, 2), ("C", "A", 1, 1)}
    related = {r["base"]: r["related"] for r in D.related_map(pairs).collect()}
    assert related == {"A": ["B"], "B": ["A", "C"], "C": ["A", "B"]}


def test_proxy_finds_the_postings_queries_were_cut_from(spark):
    _, _, _, (p, _, w) = make(spark, 6)
    own = p.withColumn("job_id", F.concat(F.lit("k"), F.col("row_id").cast("string")))
    queries = X.make_query_set(own, 20, min_techs=3)
    assert queries.where(F.size("techs") < 1).count() == 0
    full = X.evaluate(X.matcher_recommender(own, w, k=240), queries, 240, (1.0,)).first()
    assert full["n"] == 20 and full["recall"] == 1.0
    with pytest.raises(ValueError):
        X.evaluate(X.matcher_recommender(own, w), queries, 10, (0.9,))
    expected = X.random_expected(own, 10).first()
    assert abs(expected["recall"] - 10 / 240) < 1e-12
    assert X.random_baseline(own, queries, 240).agg(F.min("recall")).first()[0] == 1.0


def test_several_schemes_make_no_row_per_pair(spark, monkeypatch):
    """Queries and profiles that all share a skill: products of matrices choose, and only chosen pairs become rows."""
    chosen = []
    monkeypatch.setattr(M, "_rejoined", lambda a, b, run=M._rejoined: chosen.append(a.count()) or run(a, b))
    rows = [(i, f"j{i // 2}" if i < 40 else None if i == 40 else f"k{i}", ["A"] + [t for b, t in enumerate("BCDEFGH") if i >> b & 1], None) for i in range(128)]
    pool = spark.createDataFrame(rows, "row_id long, job_id string, techs array<string>, location string")
    asks = spark.createDataFrame([(q, ["A", "BCDEFGH"[q % 7], "unknown"]) for q in range(20)], "query_id long, techs array<string>")
    w = spark.createDataFrame([(t, 0.5 + i) for i, t in enumerate("ABCDEFGH")], "tech string, idf double").withColumn("idf", F.col("idf").cast("decimal(18,12)"))

    def run():
        out = M.top_matches_by_scheme(asks, pool, w, 3, list(M.SCORERS))
        return sorted(map(str, out.select("scheme", "query_id", "rank", "job_id", "score", "matched_techs").collect()))
    got = run()
    assert chosen and max(chosen) <= 3 * 20 * len(M.SCORERS) * 4
    monkeypatch.setattr(M, "MOST_QUERIES", 0)
    assert got == run()
