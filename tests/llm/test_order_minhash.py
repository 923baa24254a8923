import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from gonggo.llm import bytetext, order_minhash
from gonggo.llm.queries import QUERIES, op2_order_minhash

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def mix(x):
    return int(bytetext.mix(np.array([x & MASK], np.uint64))[0])


def tokens(text):
    for run in text.encode().replace(b"\n", b" ").replace(b"\t", b" ").split(b" "):
        yield from (run[i:i + 24] for i in range(0, len(run), 24))


def brute(text, m, k, picked):
    """Order MinHash of one text, element by element."""
    values = bytetext._BYTE_VALUES
    p = 0xD6E8FEB86659FD93
    words = [mix(sum(int(values[b]) * pow(p, i, 1 << 64) for i, b in enumerate(t))) for t in tokens(text)]
    factors = [int(f) for f in bytetext.odd_numbers(k, 11)]
    end = int(order_minhash._END)
    kmers = [mix(sum(mix((words[i + j] if i + j < len(words) else end) + f) * f for j, f in enumerate(factors)))
             for i in range(len(words))]
    met, hashes = {}, []
    for x in kmers:
        hashes.append(mix(x + met.get(x, 0) * 0x9E3779B97F4A7C15))
        met[x] = met.get(x, 0) + 1
    out = []
    parts = [int(f) for f in bytetext.odd_numbers(picked, 300)]
    for a, b in zip(bytetext.odd_numbers(m, 100), bytetext.odd_numbers(m, 200)):
        if not hashes:
            out.append(0)
            continue
        ranked = sorted(range(len(hashes)), key=lambda i: (((hashes[i] ^ int(b)) * int(a) & MASK) >> 28, i))
        least = sorted(ranked[:picked])
        entry = sum(mix(kmers[i] + f) * f for i, f in zip(least, parts))
        entry += sum(end * f for f in parts[len(least):])
        out.append(mix(entry) >> 48)
    return out


def signed(texts, *args):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    return order_minhash.signatures(np.frombuffer(b"".join(raw), np.uint8), offsets, *args)


def test_against_brute_force():
    rng = random.Random(1)
    texts = ["", " ", "a", "a a a a", "é" * 40, "one two"] + [
        "".join(rng.choice(["a ", "b ", "cc ", "\n", "日本 ", "x" * 30]) for _ in range(rng.randrange(40))) for _ in range(40)]
    for m, k, picked in ((16, 2, 2), (8, 1, 1), (8, 3, 3)):
        assert signed(texts, m, k, picked).tolist() == [brute(t, m, k, picked) for t in texts]


def same(a, b):
    x = signed([a, b], 512)
    return (x[0] == x[1]).mean()


def test_sensitive_to_edits_and_order():
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    text = " ".join(words)
    few, many = list(words), list(words)
    for i in range(0, 400, 40):
        few[i] = "x"
    for i in range(0, 400, 8):
        many[i] = "x"
    assert same(text, text) == 1 > same(text, " ".join(few)) > same(text, " ".join(many)) > 0.1
    swapped = " ".join(words[200:] + words[:200])
    assert 0.35 < same(text, swapped) < 0.65  # the same k-mers: plain MinHash would see no change
    assert same(text, " ".join(f"v{i}" for i in range(400))) < 0.05


def check(rows, docs):
    order = sorted(docs, key=lambda d: -(d[0] if d[0] is not None else -2**63))
    by = {d: (t or "", order[(i + 1) % len(order)][1] or "", order[(i + 1) % len(order)][0])
          for i, (d, t) in enumerate(order)}
    prints = {r.doc_id: bytes.fromhex(r.fingerprint) for r in rows}
    assert len(rows) == len(docs) and set(prints) == set(by)
    part = lambda a, b: float((np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)).mean())
    for r in rows:
        text, following, next_id = by[r.doc_id]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        want = signed([text, edited]).astype(">u2")
        assert r.fingerprint == want[0].tobytes().hex() and r.edited_fingerprint == want[1].tobytes().hex()
        assert r.near_edited == part(want[0].tobytes(), want[1].tobytes())
        assert r.near_next == part(prints[r.doc_id], prints[next_id])


def test_query(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(QUERIES["op2_order_minhash"](spark, SF).collect(), docs)


def test_edges(spark, tmp_path):
    docs = [(5, "a b c d"), (9, None), (None, "x y"), (-4, ""), (100, "word " * 30000), (7, "a b c d"), (8, "🙂é日b")]
    for i, some in enumerate((docs, docs[:1], [])):
        df = spark.createDataFrame(some, "doc_id long, text string").withColumn("__block", F.lit(1))
        df.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        check(op2_order_minhash(spark, f"{tmp_path}/{i}").collect(), some)
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (0, "c")], "doc_id long, text string")
    twice.write.parquet(f"{tmp_path}/t/documents.parquet")
    rows = op2_order_minhash(spark, f"{tmp_path}/t").collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 1, 1] and all(r.near_next is not None for r in rows)
