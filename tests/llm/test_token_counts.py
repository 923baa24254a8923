import gc
import random
import weakref

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gonggo.llm import token_counts
from gonggo.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def lengths(texts, path=PATH):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t or "")) for t in texts]
    model = Tokenizer.from_file(path)
    return [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_query_against_library(spark):
    rows = {r.doc_id: r for r in QUERIES["op9_token_counts"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert [rows[d.doc_id].n_tokens for d in docs] == lengths([d.text for d in docs])
    assert all(rows[d.doc_id].n_bytes == len((d.text or "").encode()) for d in docs)
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows.values())


def test_random_texts(spark):
    rng = random.Random(3)
    parts = ["a", "it's", " 'll", "\x1c", "\x85", "\xa0", "\n\n", "   ", "  x", "7", "½", "日本", "é", "<|endoftext|>",
             "<|end", "_", "\0", "🙂", "​", "\t", "don't", " DON'T", "ǅ", "٣", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(1500)]
    texts += [None, "", " ", "x" * 50000, "<|endoftext|>" * 3, "word " * 40000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = dict(token_counts.with_token_counts(docs, PATH, out="n_tokens", table_size=50)
               .select("doc_id", "n_tokens").collect())
    assert [got[i] for i in range(len(texts))] == lengths(texts)
    assert token_counts.with_token_counts(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(spark, name):
    path, texts = public_tokenizers.path(name), ["Hello  World", None, "", "naïve 日本 <s>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(token_counts.with_token_counts(docs, path).select("doc_id", "n_tokens").collect())
    assert [got[i] for i in range(len(texts))] == lengths(texts, path)


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_SIZE", 3)
    count = token_counts.TextCounter(PATH, {"a": 1})
    text = "a bb ccc dddd eeeee bb"
    assert [count(text), count(text)] == lengths([text, text])
    assert len(count.lengths) <= 5


def test_counter_goes_with_its_table(spark):
    table = spark.sparkContext.broadcast(("", b""))
    counter = token_counts._counter(PATH, table)
    assert token_counts._counter(PATH, table) is counter
    gone = weakref.ref(counter)
    del counter, table
    gc.collect()
    assert gone() is None


def test_known_words_need_no_pattern(monkeypatch):
    asked = []
    monkeypatch.setattr(token_counts, "_PARTS", lambda word: asked.append(word) or [word])
    count = token_counts.TextCounter(PATH, {" 7x": 2})
    text = "Word word, word 7x naïve; 日本. word!\nword"
    assert count(text) == lengths([text])[0]
    assert asked == ["\n"]


def test_words_of_every_blank_and_mark():
    rng, count = random.Random(8), token_counts.TextCounter(PATH)
    marks = [chr(c) for c in range(128)] + list("\x85\xa0   　​½²Ⅷ٣ǅſé日🙂́") + ["'s", "'ll", "<|endoftext|>"]
    texts = ["".join(rng.choices(marks + [" "] * 40 + ["ab"] * 40, k=rng.randrange(14))) for _ in range(20000)]
    assert [count(t) for t in texts] == lengths(texts)
