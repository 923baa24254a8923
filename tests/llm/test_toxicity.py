import random

import numpy as np
from pyspark.sql import functions as F

from gonggo.llm import toxicity
from gonggo.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def quality(pairs):
    hit = sum(a and b for a, b in pairs)
    return hit / max(sum(a for a, _ in pairs), 1), hit / max(sum(b for _, b in pairs), 1)


def test_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    chain = toxicity.fit_chain(docs, labels.where(~held), ("toxic",))
    rows = chain.predict(docs.join(labels.where(held), "doc_id")).select("toxic", "is_toxic", "p_toxic").collect()
    precision, recall = quality([(r.is_toxic, r.toxic == 1) for r in rows])
    assert len(rows) > 500 and precision > 0.9 and recall > 0.85
    assert all(0 <= r.p_toxic <= 1 for r in rows)


def test_query(spark):
    rows = QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 == len({r.doc_id for r in rows})
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    precision, recall = quality([(r.is_toxic, labels[r.doc_id] == 1) for r in rows if r.doc_id in labels])
    assert precision > 0.9 and recall > 0.85


def made(spark, n=400):
    """b holds where a holds and the text says `then`: the second model needs the first."""
    rng, rows = random.Random(1), []
    for i in range(n):
        a, then = rng.random() < 0.5, rng.random() < 0.5
        filler = " ".join(f"w{rng.randrange(50)}" for _ in range(6))
        rows.append((i, f"{filler} {'bad' if a else 'good'} {'then' if then else ''}", int(a), int(a and then)))
    return spark.createDataFrame(rows, "doc_id long, text string, a int, b int")


def test_chain_feeds_earlier_probabilities(spark):
    data = made(spark)
    chain = toxicity.fit_chain(data.select("doc_id", "text"), data.select("doc_id", "a", "b"), ("a", "b"))
    assert len(chain.links[0].before) == 0 and len(chain.links[1].before) == 1 and chain.links[1].before[0] > 0.1
    rows = chain.predict(data).collect()
    assert all(r.is_a == (r.a == 1) and r.is_b == (r.b == 1) for r in rows)


def test_link_against_dense_gradient_descent(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(toxicity, "DEVIATIONS", -1.0)
    rows = [np.unique(rng.integers(0, 12, rng.integers(2, 6))) for _ in range(80)]
    words = toxicity.Words(np.concatenate(rows).astype(np.int32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    earlier = rng.normal(size=(80, 1))
    labels = (np.array([3 in r for r in rows]) ^ (rng.random(80) < 0.2)).astype(float)
    x = np.zeros((80, 14))
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, 12], x[:, 13] = earlier[:, 0], 1
    w, kept = np.zeros(14), np.r_[np.full(13, 0.01), 0]
    for _ in range(60_000):
        w -= 0.5 * (x.T @ (1 / (1 + np.exp(-x @ w)) - labels) / 80 + kept * w)
    link = toxicity.fit_link("a", words, earlier, labels, penalty=0.01, steps=500)
    assert np.abs(np.r_[link.words[:12], link.before, link.offset] - w).max() < 0.02


def test_out_of_fold(monkeypatch):
    """The model of a fold never sees the fold's rows."""
    seen = []
    fit = toxicity.fit_link
    monkeypatch.setattr(toxicity, "fit_link", lambda c, words, e, y: seen.append(words.rows) or fit(c, words, e, y))
    words = toxicity.Words(np.arange(9, dtype=np.int32), np.arange(10))
    labels = np.array([[0, 1]] * 4 + [[1, 0]] * 5, float)
    toxicity.learn(words, labels, ("a", "b"), np.arange(9) % 3)
    assert seen == [6, 6, 6, 9] * 2


def test_edges(spark):
    data = made(spark, 60).withColumn("features", F.lit("x"))
    odd = spark.createDataFrame([(1000, None, "x"), (1001, "", "x"), (1002, "bad then " * 50000, "x"), (1002, "12", "x")],
                                "doc_id long, text string, features string")
    labels = data.select("doc_id", "a", "b").unionByName(data.select("doc_id", "a", "b").limit(3)).unionByName(
        spark.createDataFrame([(None, 1, 1), (5, None, 1), (99999, 1, 1)], "doc_id long, a int, b int"))
    chain = toxicity.fit_chain(data, labels, ("a", "b"))
    rows = chain.predict(odd).collect()
    assert len(rows) == 4 and all(r.features == "x" and r.p_a is not None for r in rows)
    assert chain.predict(odd.limit(0)).count() == 0
    none = toxicity.fit_chain(data, labels.limit(0), ("a", "b")).predict(odd).collect()
    assert all(r.p_a < 1e-9 and not r.is_a for r in none)
    same = toxicity.fit_chain(data, labels.withColumn("b", F.lit(1)), ("a", "b")).predict(odd).collect()
    assert all(r.p_b > 1 - 1e-9 and r.is_b for r in same)
