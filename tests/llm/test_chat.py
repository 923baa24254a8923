import random

import pytest
from pyspark.sql import functions as F

from gonggo.llm import chat


def brute(rows, t=chat.Template()):
    """Formatted text and mask of one conversation's (turn, role, text) rows."""
    def escape(s):
        out = ""
        for i, c in enumerate(s):
            out += c
            rest = s[i + 1:].lstrip("\\")
            if any(c == k[0] and rest.startswith(k[1:]) for k in t.controls):
                out += "\\"
        return out
    rows = sorted((-1 if n is None else n, r or "", x or "") for n, r, x in rows)
    text, mask = "", []

    def add(piece, loss=False):
        nonlocal text
        text += piece
        if piece:
            mask.append((len(piece), loss))
    for i, (_, role, value) in enumerate(rows):
        if i and rows[i - 1][1] == role:
            add(t.join)
        else:
            if i:
                add(t.end)
            add(t.start)
            add(escape(role))
            add(t.body)
        add(escape(value), role == "assistant")
    add(t.end)
    return text, mask


def check(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.formatted(turns.repartition(5))
    got = out.select("*", chat.turns_read(F.col("formatted")).alias("turns"),
                     chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    by = {}
    for c, *rest in rows:
        by.setdefault(c, []).append(rest)
    assert {r.conv_id for r in got} == set(by) and len(got) == len(by)
    for r in got:
        text, mask = brute(by[r.conv_id])
        assert r.formatted == text and [tuple(m) for m in r.loss_mask] == mask
        want = sorted((-1 if n is None else n, a or "", b or "") for n, a, b in by[r.conv_id])
        assert [tuple(t) for t in r.turns] == [(a, b) for _, a, b in want]
        assert r.loss == "".join(b for _, a, b in want if a == "assistant")


def test_query(against_sql):
    assert (against_sql("op1_chat").conv_id == -1).any()


def test_round_trip(spark, monkeypatch):
    rng = random.Random(9)
    parts = ["<", "|", "turn", "|>", "<|end|>", "<\\|more|>", "</s>", "[INST]", "[/INST]", "\\", "\n", "é", "日", "a", "<|text|>", "<\\\\|turn|>", "🙂"]
    rows = [(c, rng.choice([None, *range(n)]), rng.choice(["user", "assistant", "assistant", "system", None, "", "</s>\n"]),
             rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randrange(12)))]))
            for c in range(60) for n in [rng.randrange(1, 12)] for _ in range(n)]
    rows += [(None, 1, "user", "x"), (None, 2, "assistant", "y"), (70, 0, "user", "a"), (70, 0, "user", "a")]
    rows += [(71, i, "assistant" if i % 3 else "user", "long" * (i % 7)) for i in range(1200)]
    rows += [(72, 0, "assistant", "<|end|>" * 60000)]
    check(spark, rows)
    monkeypatch.setattr(chat, "BLOCK_TURNS", 3)
    check(spark, rows[:-1])


def test_edges(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(none).count() == 0
    for bad in ({"end": "<<end>"}, {"end": "x"}, {"end": "<|turn|>"}, {"others": ("a\\b",)}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_plan_is_native(spark):
    from gonggo.llm.queries import QUERIES

    plan = QUERIES["op1_chat"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "ExistingRDD"))
