import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gonggo.llm import decontaminate, packing

from test_decontaminate import brute as brute_contamination
from test_jaccard_join import brute as brute_components, with_additions
from test_packing import whole
from test_suffix_dedup import brute as brute_repeats

SF = "/root/testdata/sf0.001"


def cut(text, spans):
    """The text without the spans; a character that a span cuts stays."""
    out, at = b"", 0
    data = text.encode()
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out, at = out + data[at:a], b
    return (out + data[at:]).decode()


def expected(docs, items):
    """(doc_id, text) of what each stage but the last keeps."""
    docs = [(d, t) for d, t in docs if t and any(map(str.isalpha, t))]
    yield docs
    components = brute_components(docs, corpus_pipeline.NEAR)
    docs = [(d, t) for d, t in docs if components[d][0] == 0 or components[d][1] == d]
    yield docs
    spans = brute_repeats(docs)
    docs = [(d, cut(t, spans[d][0])) for d, t in docs]
    yield docs
    found = brute_contamination(docs, items, decontaminate.N_WORDS)
    yield [(d, t) for d, t in docs if not found[d][1]]


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 %", "en", "s", 4)], docs.schema)
    docs = docs.unionByName(extra).withColumn("repeats", F.lit(7))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sizes = [len(rows)]
    for (name, stage), want in zip(corpus_pipeline.STAGES, expected(rows, items)):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        columns = docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        got = docs.collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted(want), name
        assert all(r.n_chars == len(r.text) for r in got) or name == "language"
        sizes.append(len(got))
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[4] < sizes[3]
    model = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    lengths = [(d, len(model.encode(t, add_special_tokens=False).ids)) for d, t in want]
    whole(corpus_pipeline.STAGES[4][1](spark, docs, SF).collect(), lengths, packing.CAPACITIES)


def test_run(spark):
    from __spark_entry__ import oracle_sql, queries

    rows = queries()["pipeline"](spark, SF).collect()
    ids = {d for r in rows for d in r.doc_ids}
    assert len(ids) > 100 and "pipeline" not in oracle_sql()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_and_repeated(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert stage(spark, docs.limit(0), SF).count() == 0
    twice = docs.limit(1).unionByName(docs.limit(1))
    if name == "near_copies":
        assert stage(spark, twice, SF).count() == 1
    elif name != "packing":
        assert stage(spark, twice, SF).count() in (0, 2)


def test_near_copies_with_an_added_piece(spark):
    """Near copies that differ by added rare words: only the first stays."""
    docs = with_additions(random.Random(5), range(3, 24, 2))
    rows = corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), SF).collect()
    components = brute_components(docs, corpus_pipeline.NEAR)
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in docs if components[d][1] == d)
    assert len(rows) < len(docs) - 4


def test_texts_of_one_id(spark):
    """Of an id with several texts, only the copy of an earlier document goes."""
    docs = spark.createDataFrame(
        [(1, "a b c d e f g"), (3, "a b c d e f g"), (3, "h i j k l m n"), (3, None), (3, None), (3, " "),
         (4, "o p q r s t"), (4, "o p q r s t"), (None, "a b c d e f g"), (5, "h i j k l m n")], "doc_id long, text string")
    rows = corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [
        (1, "a b c d e f g"), (3, "h i j k l m n"), (3, None), (3, None), (3, " "), (4, "o p q r s t"), (None, "a b c d e f g")]))


def test_corpus_without_labels(spark):
    docs = spark.createDataFrame([(1, "the cat", None), (2, "日本", None), (3, "12 %", None), (4, "", None), (5, None, None)],
                                 "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.known_language(spark, docs, SF).collect()) == [1, 2]
