"""Copies, splits, figures and models."""

import random

import pytest
from pyspark.sql import Observation, functions as F

from gonggo.functions.ranks import hash_order, rank_in_group
from gonggo.operators import features as V
from gonggo.operators import metrics as E
from gonggo.operators import models as M
from gonggo.operators import textprep as X


def test_rank_in_group_is_exact_for_hot_groups(spark):
    group = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string"))
    df = spark.range(3000).select("id", group.alias("g")).withColumn("h", hash_order(1, "id"))
    rows = rank_in_group(df, ["g"], "h", "id", out="r", slice_rows=5).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["g"], []).append((r["h"], r["id"], r["r"], r["r_n"]))
    assert sum(len(v) for v in groups.values()) == 3000
    for members in groups.values():
        assert [m[2] for m in sorted(members)] == list(range(1, len(members) + 1))
        assert {m[3] for m in members} == {len(members)}


def test_mask_and_template(spark):
    df = spark.createDataFrame([("접수기간 " + "가" * 100 + " 급구", "x"),
                                ("글 상세요강 접수기간∙방법 기업정보 추천공고 스크랩 내용 본 채용정보는 사람인", "jobkorea"),
                                ("좋은 포지션을 추천드립니다. Saramin 글", "saramin"), (None, "x")],
                               "t string, s string")
    rows = df.select(X.mask_text(F.col("t")).alias("m"), X.strip_template(F.col("t"), F.col("s")).alias("c")).collect()
    assert rows[0]["m"] == " <MASK> " + "가" * 11 + "  <MASK> "
    assert [r["c"] for r in rows[1:]] == ["글 내용", "글", ""]
    with pytest.raises(ValueError):
        X.apply_variant(F.col("t"), F.col("s"), "masked+odd")


def test_copies_and_group_split(spark):
    rng = random.Random(3)
    texts = ["복사된 글 " * 3 if i % 3 == 0 else f"글 {rng.randint(0, 400)} " + "나" * (700 if i % 5 == 0 else 3) + str(i % 50)
             for i in range(900)]
    df = spark.createDataFrame([(i, t, "abc"[i % 3], 1 + i % 4) for i, t in enumerate(texts)],
                               "row_id long, raw_text string, source string, y int")
    kept = X.drop_exact_copies(df)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(" ".join(t.split()).lower(), i)
    assert {r["row_id"] for r in kept.select("row_id").collect()} == set(first.values())
    split = X.group_split(X.absorb_rare(kept, "y")).cache()
    assert X.shared_groups(split).first()[0] == 0
    shares = {r["split"]: r["n"] / split.count() for r in split.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(shares["test"] - 0.2) < 0.06 and abs(shares["val"] - 0.16) < 0.06
    assert X.sample_rows(df, 37).count() == 37
    part = X.stratified_split(df, "source")
    assert [r["n"] for r in part.where("split = 'test'").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()] == [60] * 3


def test_rare_strata_join_the_largest_of_their_source(spark):
    rows = [("a", 1)] * 9 + [("a", 2)] * 6 + [("a", 3)] * 2 + [("b", 1)] * 3
    out = X.absorb_rare(spark.createDataFrame(rows, "source string, y int"), "y")
    got = {(r["source"], r["y"]): r["stratum"] for r in out.distinct().collect()}
    assert got == {("a", 1): "a__1", ("a", 2): "a__2", ("a", 3): "a__1", ("b", 1): "a__1"}


def test_figures(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 5), rng.randint(1, 5)) for _ in range(200)]
    n, cells = len(rows), {}
    for r in rows:
        cells[r] = cells.get(r, 0) + 1
    margin = [[sum(1 for r in rows if r[s] == c) for c in range(1, 6)] for s in (0, 1)]
    expected = sum((i - j) ** 2 * margin[0][i - 1] * margin[1][j - 1] / n for i in range(1, 6) for j in range(1, 6))
    qwk = 1 - sum((a - b) ** 2 * c for (a, b), c in cells.items()) / expected
    df = spark.createDataFrame(rows, "y int, p int")
    got = E.evaluate(df).first()
    assert abs(got["qwk"] - qwk) < 1e-12
    assert abs(got["mae"] - sum(abs(a - b) for a, b in rows) / n) < 1e-12
    f1 = [r["f1"] for r in E.class_report(df).collect()]
    assert abs(got["macro_f1"] - sum(f1) / 5) < 1e-12
    one = E.evaluate(df.withColumn("y", F.lit(2)).withColumn("p", F.lit(2))).first()
    assert one["qwk"] is None and one["macro_f1"] == 1.0
    half = spark.createDataFrame([([0.0, 0.5, 0.0, 0.5, 0.0],), ([0.5, 0.0, 0.0, 0.0, 0.5],), ([0.5, 0.5, 0.0, 0.0, 0.0],)], "p array<double>")
    assert [r[0] for r in half.select(E.expected_level(F.col("p"))).collect()] == [3, 3, 1]


def texts(spark):
    rng = random.Random(7)
    words = {1: ["느긋", "안정"], 2: ["보통", "일반"], 3: ["빠른", "급한"]}
    rows = []
    for i in range(240):
        y = 1 + i % 3
        rows.append((i, "ab"[i % 2], " ".join([rng.choice(words[y]) for _ in range(4)] + [rng.choice(["회사", "업무", "글"]) for _ in range(3)]), y))
    return spark.createDataFrame(rows, "row_id long, source string, raw_text string, y int")


def test_tfidf_is_a_unit_vector(spark):
    df = spark.createDataFrame([(1, "가나 가나 다라"), (2, "가나 마바"), (3, "")], "id long, t string")
    model = V.fit_tfidf(df, "t", min_df=1, max_df=1.0)
    assert model.vocabulary == ("가나", "가나 가나", "가나 다라", "가나 마바", "다라", "마바")
    rows = {r["id"]: r["tfidf"] for r in model.transform(df, "t").collect()}
    assert abs(rows[1].norm(2) - 1) < 1e-12 and rows[3].numNonzeros() == 0


def test_train_save_load_and_guard(spark, tmp_path):
    df = texts(spark)
    train, val = df.where("row_id % 4 > 0"), df.where("row_id % 4 = 0")
    recipe = M.Recipe("full", max_features=50, min_df=2)
    model, figures = M.train_and_select(train, val, recipe, max_iter=10)
    assert figures.count() == 3
    before = {r["row_id"]: r["p"] for r in model.predict(val).collect()}
    model.save(spark, str(tmp_path / "m"))
    again = M.UrgencyModel.load(spark, str(tmp_path / "m"))
    rows = again.predict_with_scope(val).collect()
    assert {r["row_id"]: r["p"] for r in rows} == before
    assert sum(r["p"] == r["y"] for r in rows) / len(rows) > 0.9 and not any(r["in_scope"] for r in rows)
    again.tfidf = V.TfidfModel(model.tfidf.vocabulary[:-1], model.tfidf.idf[:-1])
    with pytest.raises(ValueError):
        again.predict(val)


def test_boosted_model(spark):
    df = texts(spark)
    tfidf, (tr, va) = M.vectors(df.where("row_id % 4 > 0"), [df.where("row_id % 4 = 0")],
                                M.Recipe("full", max_features=30, min_df=2))
    model = M.fit_boosted(tr, va, trees=3, depth=2)
    got = M.predict(model, va, "expected_round")
    assert E.evaluate(got).first()["accuracy"] > 0.5
    assert len(M.importance(model, tfidf, 3)) == 3


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 6 + [(2,)] * 2, "y int")
    assert {r["y"]: r["weight"] for r in V.class_weights(df).collect()} == {1: 8 / 12, 2: 2.0}


def test_svm_predicts_after_a_table_was_observed(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    tfidf, (tr, va) = M.vectors(texts(spark).where("row_id % 4 > 0"), [texts(spark).where("row_id % 4 = 0")],
                                M.Recipe("full", max_features=30, min_df=2))
    got = M.predict(M.fit_linear_svm(tr, max_iter=5), va, "argmax")
    assert got.where("p IS NULL").count() == 0
