import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gonggo.llm import bytetext, exchange, suffix_dedup
from gonggo.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(docs, length=100):
    """Removed bytes of each (doc_id, text), by a table of all strings."""
    first, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: -2**63 if d[0] is None else d[0]):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i:i + length]
            if s in first:
                covered[i:i + length] = b"\1" * length
            first.add(s)
        spans, at = [], 0
        while (a := covered.find(1, at)) >= 0:
            b = covered.find(0, a)
            at = b if b >= 0 else len(covered)
            spans.append((a, at))
        out[doc] = spans, bytes(b for b, c in zip(data, covered) if not c)
    return out


def whole_characters(text, spans):
    """The text without the characters that lie in a span as a whole."""
    gone = {i for a, b in spans for i in range(a, b)}
    out, at = "", 0
    for c in text:
        places = range(at, at + len(c.encode()))
        out += "" if gone.issuperset(places) else c
        at = places.stop
    return out


def check(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"__doc": F.lit(1), "repeats": F.lit(2), "tie": F.lit(3)})
    out = suffix_dedup.with_repeats(df.repartition(3), **how)
    rows = out.withColumns({"digest": suffix_dedup.kept_sha256(F.col("text"), F.col("repeats")),
                            "kept": suffix_dedup.kept_text(F.col("text"), F.col("repeats"))}).collect()
    want = brute(docs)
    assert len(rows) == len(docs)
    for r in rows:
        spans, kept = want[r.doc_id]
        assert [tuple(s) for s in r.repeats] == spans, r.doc_id
        assert r.digest == hashlib.sha256(kept).hexdigest() and r.tie == 3
        assert r.kept == (None if r.text is None else whole_characters(r.text, spans))


def texts(rng):
    word = lambda: rng.choice(["the ", "of ", "é", "日本", f"w{rng.randrange(500)} ", "a b"])
    some = ["".join(word() for _ in range(rng.randrange(90))) for _ in range(25)]
    shared = ["".join(word() for _ in range(n)) for n in (30, 45, 80)] + ["x" * 150, "ab" * 99, "line of a page that many share, over and over again.\n"]
    docs = []
    for _ in range(110):
        parts = rng.choices(some, k=rng.randrange(3)) + rng.choices(shared, k=rng.randrange(4))
        rng.shuffle(parts)
        text = "".join(parts)
        if text and rng.random() < 0.4:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["?", "", "zz"]) + text[at + rng.randrange(3):]
        docs.append(text)
    return docs + [None, "", "short", "y" * 99, "y" * 100, "y" * 101, "q" * 5000, "".join(word() for _ in range(20000))]


@pytest.mark.parametrize("group_rows", [2048, 3])
def test_against_brute_force(spark, group_rows):
    rng = random.Random(group_rows)
    docs = list(enumerate(texts(rng)))
    docs += [(1000 + i, t) for i, (_, t) in enumerate(docs[:40])] + [(None, docs[3][1])]
    rng.shuffle(docs)
    check(spark, docs, group_rows=group_rows)


def test_a_gram_with_thousands_of_surroundings(spark, monkeypatch):
    """Passages in thousands of documents, all different around them, go through interval trees of halves alone."""
    rng = random.Random(12)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (100, 118, 131, 60)]
    docs = []
    for i in range(2600):
        text = rng.choice(passages)
        if rng.random() < 0.2:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1:]
        lead, tail = ("".join(rng.choice("uvwxyz") for _ in range(rng.randrange(60))) for _ in range(2))
        docs.append((i, lead + text + tail))
    docs += [(5000 + i, text) for i, (_, text) in enumerate(docs[:50])]
    sizes, split = [], suffix_dedup._split_groups

    def seen(hot, *how):
        sizes.append(hot.groupBy("group").count().agg(F.max("count")).first()[0])
        return split(hot, *how)

    monkeypatch.setattr(suffix_dedup, "_split_groups", seen)
    check(spark, docs)
    check(spark, docs, group_rows=2)
    assert min(sizes) > suffix_dedup.GROUP_ROWS


def around_one_passage(rng, n):
    """Documents that hold one passage, some with a changed byte, with other bytes and lengths around it; some repeat."""
    passage = "".join(rng.choice("abcdefgh ") for _ in range(140))
    docs = []
    for i in range(n):
        text = passage
        if i % 4 == 0:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1:]
        lead, tail = ("".join(rng.choice("uvwxyz") for _ in range(rng.randrange(60))) for _ in range(2))
        docs.append((n - i, lead + text + tail))
    return docs + [(1000 + i, text) for i, (_, text) in enumerate(docs[:9])] + [(2000, "ab" * 200), (2001, "x" + "ab" * 130)]


def test_a_group_that_a_task_holds_is_halved_there(spark, monkeypatch):
    """Rows of a group are multiplied between tasks only where no task could hold them."""
    docs = around_one_passage(random.Random(31), 90)
    with monkeypatch.context() as patch:
        patch.setattr(suffix_dedup, "_halved", None)
        check(spark, docs, group_rows=3)
    check(spark, docs, group_rows=3, task_rows=20)


def test_halves_of_a_group():
    rows = [(70, 68, b"p" * 68 + b"g" * 100, 5, 0), (70, 68, b"q" + b"p" * 67 + b"g" * 100, 3, 0), (9, 9, b"p" * 9 + b"g" * 100, 4, 0)]
    spans, groups = suffix_dedup.halved_group(rows, 0, 34, 100)
    assert spans == [(5, 0, 36, 170)]
    assert groups == [[(70, 34, b"p" * 34 + b"g" * 100, 3, 0), (9, 9, b"p" * 9 + b"g" * 100, 4, 0)]]
    spans, groups = suffix_dedup.halved_group(rows, 35, 68, 100)
    assert spans == [] and groups == [[(70, 68, b"q" + b"p" * 67 + b"g" * 65, 3, 0), (70, 68, b"p" * 68 + b"g" * 65, 5, 0)]]


def test_long_texts_in_pieces():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 30_000).astype(np.uint8)
    data[9000:12_000] = 120
    offsets = np.array([0, 0, 40, 7000, 7050, 29_000, 30_000])
    whole = suffix_dedup.anchors(data, offsets)
    assert len(whole[0]) > 300
    for piece in (64, 1000, 7001):
        for got, want in zip(suffix_dedup.anchors(data, offsets, piece=piece), whole):
            assert got.tolist() == want.tolist()
    at, _, of = whole
    begin, end = np.maximum(offsets[of], at - 68), np.minimum(offsets[of + 1], at + 100)
    around = {}
    for hashes in (suffix_dedup.surrounding_hashes(data, begin, at, end), suffix_dedup.surrounding_hashes(data, begin, at, end, piece=500)):
        for a, b, c, h, k in zip(begin, at, end, *hashes):
            around.setdefault((int(h), int(k)), set()).add((data[a:c].tobytes(), int(b - a)))
    assert all(len(texts) == 1 for texts in around.values())
    assert len(around) == len(set().union(*around.values()))


def test_maximal_repeats_against_pairs():
    rng = random.Random(6)
    for _ in range(200):
        rows = sorted({("G" * 32 + "".join(rng.choice("ab") for _ in range(rng.randrange(8))),
                        "".join(rng.choice("ab") for _ in range(rng.randrange(7)))) for _ in range(rng.randrange(2, 12))})
        after, before = [a.encode() for a, _ in rows], [b.encode() for _, b in rows]
        length = 32 + rng.randrange(8)
        got = {(left, right, tuple(m)) for left, right, m in suffix_dedup.maximal_repeats(before, after, length)}
        want = set()
        for i in range(len(rows)):
            for j in range(i):
                left, right = suffix_dedup.common(before[i], before[j]), suffix_dedup.common(after[i], after[j])
                if left + right >= length:
                    want.add((left, right, tuple(k for k in range(len(rows)) if before[k][:left] == before[i][:left] and len(before[k]) >= left
                                                 and after[k][:right] == after[i][:right] and len(after[k]) >= right)))
        assert got == want


def test_query(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs)
    rows = QUERIES["op4_suffix_dedup"](spark, SF).collect()
    assert len(rows) == len(docs) and sum(r.n_removed for r in rows) > 0
    for r in rows:
        spans, kept = want[r.doc_id]
        size = sum(b - a for a, b in spans)
        assert (r.n_removed, r.n_spans, r.n_bytes) == (size, len(spans), len(kept) + size)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_edges(spark):
    check(spark, [])
    check(spark, [(1, "z" * 300)])
    twice = spark.createDataFrame([(2, "k" * 150), (2, "k" * 150), (1, "j")], "doc_id long, text string")
    rows = suffix_dedup.with_repeats(twice).where("doc_id = 2").collect()
    assert len(rows) == 2 and rows[0].repeats == rows[1].repeats
    text = spark.createDataFrame([("aééb",)], "t string")
    half = F.expr("array(named_struct('start', 2L, 'end', 4L))")
    assert text.select(suffix_dedup.kept_text(F.col("t"), half)).first()[0] == "aééb"


def test_texts_of_a_block_come_in_many_batches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_ROWS", 3)
    monkeypatch.setattr(suffix_dedup, "OUT_ROWS", 2)
    rng = random.Random(12)
    docs = [(i, t) for i, t in enumerate(texts(rng))]
    rng.shuffle(docs)
    check(spark, docs)


def test_a_slice_takes_little_memory():
    rng = np.random.default_rng(1)
    column = pa.array(["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(1000)])
    data, offsets = bytetext.text_bytes(column)
    bytetext._powers.cache_clear()
    tracemalloc.start()
    for low, high in bytetext.slices(offsets, bytetext.FINE_BYTES):
        part, own = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        at, _, of = suffix_dedup.anchors(part, own)
        suffix_dedup.surrounding_hashes(part, np.maximum(own[of], at - 68), at, np.minimum(own[of + 1], at + 100))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20


def test_anchors_fill_buckets_evenly():
    data = np.random.default_rng(2).integers(97, 123, 200_000).astype(np.uint8)
    _, keys, _ = suffix_dedup.anchors(data, np.array([0, len(data)]))
    sender = exchange.Sender(32)
    rows = [*sender.add(keys, np.zeros(len(keys), np.int32)), *sender.flush()]
    held = {}
    for batch in rows:
        for bucket, packed in zip(batch["bucket"].to_pylist(), batch["keys"].to_pylist()):
            held[bucket] = held.get(bucket, 0) + len(packed) // 8
    assert len(keys) > 3000 and max(held.values()) < 2 * len(keys) / 32
