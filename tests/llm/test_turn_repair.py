import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gonggo.llm import queries, turn_repair as R

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
KEEP = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def cheapest(codes):
    """The best edit letters by a search over (cost, letters), nothing else."""
    heap, best, seen = [(0, "", 0, "")], None, set()
    while heap:
        cost, letters, i, place = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            return best
        if (i, place, letters) in seen or len(letters) > 2 * len(codes) + 4:
            continue
        seen.add((i, place, letters))
        if i == len(codes) and place in ("", "a"):
            best = min(best or (cost, letters), (cost, letters))
        heapq.heappush(heap, (cost + 3, letters + "I", i, NEXT[place]))
        if i < len(codes):
            code = codes[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, place))
            if code != "-":
                more = 3 if code.isupper() else 0
                if (place, code.lower()) in KEEP:
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, code.lower()))
                heapq.heappush(heap, (cost + 3 + more, letters + "R", i + 1, NEXT[place]))
    return best


def decided(codes, step):
    front, out = R.BEGIN, ""
    for at in range(0, len(codes), step):
        front, letters = R.advance(front, codes[at:at + step])
        out += letters
    return out + R.finished(front)


def test_weights_against_search():
    rnd = random.Random(5)
    cases = ["", "s", "S", "-", "u", "a", "ua", "sua", "ss", "uu", "aa", "au", "Ua", "uA", "sS", "x", "xa", "us"]
    cases += ["".join(rnd.choice("suaaux-SUA") for _ in range(rnd.randrange(1, 8))) for _ in range(120)]
    for codes in cases:
        want = cheapest(codes)[1]
        for step in (1, 3, 16):
            assert decided(codes, step) == want, codes


def test_a_long_conversation_is_decided_as_it_goes():
    rnd = random.Random(6)
    codes = "".join(rnd.choice("uauauaxs-UA") for _ in range(3000))
    front, held = R.BEGIN, 0
    for at in range(0, len(codes), 16):
        front, _ = R.advance(front, codes[at:at + 16])
        held = max(held, *(len(p[1]) for p in front))
    assert held < 100


def brute_report(rows):
    """(turn, role, text) rows of one conversation, after damage."""
    rows = sorted(((t is not None, t or 0, r, x) for t, r, x in rows))
    seen, faults, codes = set(), [], []
    for _, _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        fault = ("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
        faults.append(fault)
        code = role[:1] if role[:1] in ("s", "u", "a") else "x"
        codes.append("-" if fault in ("blank", "duplicate") else code.upper() if fault else code)
    cost, audit = cheapest("".join(codes))
    place, at, lines = "", 0, []
    for x in audit:
        if x == "I":
            place = NEXT[place]
            lines.append({"u": "user", "a": "assistant"}[place] + ":")
            continue
        role, text = rows[at][2:]
        at += 1
        if x == "K":
            place = role[0]
            lines.append(f"{role}:{text}")
        elif x == "R":
            place = NEXT[place]
            lines.append({"u": "user", "a": "assistant"}[place] + ":" + text)
    turns = [t for there, t, _, _ in rows if there]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


SCHEMA = "conv_id long, turn long, role string, text string, there boolean, place string, fault string"


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(4)
    got = {r[0]: tuple(r[1:]) for r in R.reports(R.repaired(frame, there=F.col("there"))).collect()}
    want = {}
    for conv, turn, role, text, there in rows:
        want.setdefault(conv, [])
        if there:
            want[conv].append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {c: brute_report(r) for c, r in want.items()}


def test_cases(spark):
    ok = "Fine."
    rows = [(1, 0, "user", ok, True), (1, 1, "assistant", "Yes!", True),
            (2, 0, "system", ok, True), (2, 5, "user", "no end", True),
            (3, None, None, None, True), (3, None, "user", ok, True), (3, 2, "user", ok, True), (3, 2, "user", ok, True),
            (4, 0, "user", ok, False),
            (None, 1, "tool", ok, True), (None, 1, "", "a?\x0b ", True),
            (5, -2**62, "assistant", "é.", True), (5, 2**62, "user", " ", True),
            (6, 1, "user", "", True), (6, 1, "user", "", True), (7, 0, "user", ok, True), (7, 0, "user", ok, False)]
    check(spark, rows)


def test_random_conversations(spark):
    rnd = random.Random(9)
    rows = [(c, rnd.choice([None, 0, 1, 2, 3, 9]), rnd.choice(["user", "assistant", "system", "tool", "", None]),
             rnd.choice(["a.", "b", " ", "", "c? ", None, "d!\n"]), rnd.random() < .9) for c in range(60) for _ in range(rnd.randrange(1, 7))]
    check(spark, rows)


def test_a_hot_conversation_is_a_stream(spark):
    rows = spark.range(6000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Turn "), F.col("id"), F.lit(".")).alias("text"))
    report = R.reports(R.repaired(rows.where("turn <> 3001"))).first()
    assert (report.gaps, report.illegal, report.cost) == (1, 1, 3) and report.audit == "K" * 3001 + "I" + "K" * 2998


def test_empty(spark):
    edits = R.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert R.reports(edits).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(8)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, queries.damaged(frame).select("conv_id", "turn", "role", "text", "there").collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if k == 4 else role, {1: "", 2: text.replace(".", "").replace("!", "")}.get(k, text), k != 0)
        want += [row] * (2 if k == 3 else 1)
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(against_sql, sf):
    got = against_sql("op11_turn_repair", f"/root/testdata/{sf}")
    assert {"D", "I", "K", "R"} <= set("".join(got.audit))
