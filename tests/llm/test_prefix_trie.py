import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gonggo.llm import prefix_trie as P


def brute(seqs):
    """The nodes of {conversation: [(turn, characters)]}."""
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    children = {p: [q for q in nodes if len(q) == len(p) + 1 and q[:-1] == p] for p in nodes}
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children[p]),
                    sum(not children[q] for q in below), sum((len(nodes[q]) - 1) * (q[-1][1] if q else 0) for q in below),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def turns_of(rows):
    """Each conversation's turns, (role, text) with their characters, in order."""
    by = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            by.setdefault(c, []).append((t is not None, t or 0, digest, len(text)))
    return {c: [(d, n) for _, _, d, n in sorted(s)] for c, s in by.items()}


def headed(own, most=6):
    out = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = own.get(c - c % 100, [])[:h] + s[h:]
    return out


def check(spark, rows, heads=True):
    frame = spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id long, turn long, role string, text string, part int, path string")
    own = P.sequences(frame.repartition(3))
    want = turns_of(rows)
    if heads:
        own = P.headed(own, F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, 5)
        want = headed(want)
    out = P.trie_nodes(own)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert out.columns == names
    assert sorted(map(tuple, out.collect()), key=repr) == (brute(want) if want else [])


def test_double_array_finds_every_sequence():
    rnd = random.Random(1)
    for letters in (1, 3, 40):
        seqs = sorted({tuple(rnd.randrange(1, letters + 1) for _ in range(rnd.randrange(7))) for _ in range(80)})
        sizes = np.array([len(s) for s in seqs])
        begin = np.cumsum(sizes) - sizes
        tokens = np.array([t for s in seqs for t in s], np.int64)
        trie = P.DoubleArray.packed(tokens, begin, sizes)
        ends = set()
        for s in seqs:
            state = np.zeros(1, np.int64)
            for t in s:
                state = trie.step(state, np.array([t]))
            ends.add(int(state[0]))
        assert len(ends) == len(seqs)
        assert (trie.check != -1).sum() == len({s[:d] for s in seqs for d in range(len(s) + 1)})
        with pytest.raises(ValueError):
            trie.step(np.zeros(1, np.int64), np.array([0]))


def test_shards_cut_anywhere():
    rnd = random.Random(7)
    for _ in range(60):
        turns = [(hashlib.md5(bytes([i])).digest(), rnd.randrange(5)) for i in range(rnd.choice([1, 2, 3, 8]))]
        seqs = {c: [rnd.choice(turns) for _ in range(rnd.choice([0, 1, 2, 3, 5, 9]))] for c in rnd.sample(range(100), rnd.choice([1, 3, 20]))}
        by = {}
        for c, s in seqs.items():
            by.setdefault(tuple(s), []).append(c)
        rows = sorted((b"".join(t for t, _ in s), [n for _, n in s], len(m), min(m),
                       hashlib.sha256(",".join(map(str, sorted(m))).encode()).hexdigest()) for s, m in by.items())
        cuts = sorted(rnd.sample(range(1, len(rows)), min(len(rows) - 1, rnd.randrange(4))))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        found, merged = [], {}
        for i, part in enumerate(parts):
            before = P._common(parts[i - 1][-1][0], part[0][0]) if i else -1
            behind = P._common(part[-1][0], parts[i + 1][0][0]) if i + 1 < len(parts) else -1
            for node in P._shard_nodes(part, before, behind).to_pylist():
                if node["node"] is None:
                    found.append(node)
                elif node["node"] not in merged:
                    merged[node["node"]] = node
                else:
                    have = merged[node["node"]]
                    for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                        have[c] += node[c]
                    have["conv_id"], have["ends"] = min(have["conv_id"], node["conv_id"]), have["ends"] or node["ends"]
        got = [(n["conv_id"], n["depth"], merged[n["parent"]]["conv_id"] if n["parent"] is not None else n["parent_conv_id"],
                n["n_convs"], n["n_children"], n["n_leaves"], n["saved_tokens"], n["ends"] or P.NOTHING) for n in [*found, *merged.values()]]
        assert sorted(got, key=repr) == brute(seqs)


def test_random_conversations(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "bé", ""])) for c in rnd.sample(range(350), 120) for t in range(rnd.randrange(1, 8))]
    check(spark, rows)


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_TURNS", 5)
    rnd = random.Random(4)
    check(spark, [(c, t, "u", rnd.choice("ab")) for c in range(80) for t in range(rnd.randrange(1, 6))], heads=False)


def test_nulls_ties_and_repeats(spark):
    rows = [(1, None, "user", "x"), (1, 2, None, "y"), (1, 2, None, "y"), (2, None, "user", "x"), (2, 1, "user", None), (2, 1, "", ""),
            (None, 1, "user", "lost"), (100, 0, "user", "x"), (103, 0, "user", "z"), (-7, 0, "user", "x"), (-150, 3, "a", "b" * 5000)]
    check(spark, rows)
    check(spark, rows, heads=False)


def test_turnless_conversations_end_at_the_root(spark):
    check(spark, [(c, 0, "user", str(c)) for c in range(201, 230)])


def test_a_hot_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(9000) for t in range(2)] + [(9000 + c, 0, "user", f"own {c}") for c in range(50)]
    check(spark, rows, heads=False)


def test_empty(spark):
    check(spark, [])


def test_query(against_sql):
    against_sql("op13_prefix_trie", "/root/testdata/sf0.01")
