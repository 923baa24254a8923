import zlib

import numpy as np
from pyspark.sql import functions as F

from gonggo.llm import language
from gonggo.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_query_held_out_accuracy(spark):
    rows = QUERIES["op10_language"](spark, SF).collect()
    docs = {d.doc_id: d for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.98


def grams(text):
    low = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower())
    data = " ".join(low.split(" ")) if False else __import__("re").sub(" +", " ", low)
    raw = data.encode()
    return {raw[i:i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}


def test_kernel_against_sets():
    texts = ["The cat, the hat", "le chat et la été", "x", "Ein Ding über 99 Dinge"]
    seen = np.array([language.presence(np.frombuffer(t.encode(), np.uint8)) for t in texts]).astype(int)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert abs(int(seen[i] @ seen[j]) - len(grams(a) & grams(b))) <= 1  # hashed triples may meet


def test_scores_against_dense_kernel():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list(alphabet), 40)) for alphabet in ("abcd ", "cdef ", "efgh ") for _ in range(12)]
    seen = np.array([language.presence(np.frombuffer(t.encode(), np.uint8)) for t in texts])
    labels = np.repeat([0, 1, 2], 12)
    model = language.fit(["a", "b", "c"], seen, labels, landmarks=12)
    # With every row a landmark, Nyström is exact: compare with ridge regression on the full kernel.
    sizes = seen.sum(axis=1)
    kernel = (seen.astype(float) @ seen.T) / np.sqrt(np.outer(sizes, sizes))
    middle = np.eye(36) - 1 / 36
    target = np.where(labels[:, None] == np.arange(3), 1.0, -1.0)
    alpha = np.linalg.solve(middle @ kernel @ middle + 36 * language.RIDGE * np.eye(36), target - target.mean(axis=0))
    want = (kernel - kernel.mean(axis=0)) @ middle @ alpha + target.mean(axis=0)
    got = model.values(seen[:, model.slots], sizes)
    assert np.abs(got - want).max() < 0.02 and (got.argmax(axis=1) == labels).all()


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, None, "en"), (4, "", None),
         (5, "123 %%", "fr"), (6, "the dog", None), (6, "the dog", None), (7, "the cat " * 50000, None), (8, "日本", None)],
        "doc_id long, text string, lang string").withColumn("__lang", F.lit(1)).withColumn("language", F.lit(2))
    model = language.learned(docs, F.lit(True))
    rows = [(r.doc_id, r.language.lang, r["__lang"]) for r in language.with_language(docs, model).collect()]
    got = {a: b for a, b, _ in rows}
    assert len(rows) == 9 and got[1] == "en" and got[2] == "fr" and got[7] == "en" and got[6] == "en"
    assert got[3] == got[4] == got[5] == "und" and got[8] in ("en", "fr")
    assert language.learned(docs, F.lit(False)) is None
    none = language.with_language(docs, None).select("language.*").distinct().collect()
    assert none == [("und", 0.0)]
    assert language.with_language(docs.limit(0), model).count() == 0


def test_copies_count_once(spark):
    """The bound holds with a large copy group, and a language of few much-repeated texts is not missed."""
    docs = [(f"the cat {i % 3}", "en") for i in range(900)] + [(f"le chat {i % 2}", "fr") for i in range(700)]
    docs += [(f"ein ding {i}", "de") for i in range(1000)]
    df = spark.createDataFrame(docs, "text string, lang string").repartition(5)
    rows = language.training_rows(df, F.lit(True), "text", "lang").collect()
    assert {k: sum(r["__lang"] == k for r in rows) for k in ("de", "en", "fr")} == {"de": 300, "en": 3, "fr": 2}
    assert language.learned(df, F.lit(True)).languages == ["de", "en", "fr"]


def test_very_many_languages(spark):
    docs = [(f"the cat number {i}", "en") for i in range(30)] + [(f"le chat {i}", "fr") for i in range(20)]
    docs += [(f"mot {i}", f"l{i:04}") for i in range(3500)]
    model = language.learned(spark.createDataFrame(docs, "text string, lang string").repartition(5), F.lit(True))
    assert {"en", "fr"} <= set(model.languages) and len(model.languages) == language.LANGUAGES
