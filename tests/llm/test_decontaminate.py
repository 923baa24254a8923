import random
import re

from gonggo.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, n):
    out = {}
    windows = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        size = min(n, len(words))
        for i in range(len(words) - size + 1 if words and item is not None else 0):
            windows.setdefault(tuple(words[i:i + size]), set()).add(str(item))
    for key, text in docs:
        words, hit, ids = WORD.findall(lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if tuple(words[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    ids |= windows[tuple(words[i:i + size])]
        out[key] = (len(words), len(hit), sorted(ids))
    return out


def make(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(items, "item_id long, text string"))


def found(df):
    return {r.doc_id: (r.contamination.n_words, r.contamination.n_hit, r.contamination.item_ids)
            for r in df.collect()}


def test_query(against_sql):
    assert against_sql("op8_decontaminate").contaminated.any()


def test_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(["a", "B", "é", "c1", "日本"]) + rng.choice([" ", ", ", "\n", "--"])
                             for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(60)] + [(100, None), (101, ""), (102, "..."), (103, text(30000))]
    items = [(i, text(rng.randrange(1, 9))) for i in range(6)] + [(9, text(2) + "zz"), (10, None), (11, "?"), (None, "a B"), (0, "a")]
    for bound in (decontaminate.MAX_WINDOWS, 7):
        left, right = make(spark, docs, items)
        got = found(decontaminate.contamination(left, right, n_words=4, max_windows=bound))
        assert got == brute(docs, items, 4)


def test_edges(spark):
    docs, items = make(spark, [(1, "x one two three y"), (2, "clean"), (3, None)], [(1, "One, two THREE")])
    extra = docs.withColumn("contamination", docs.doc_id).withColumn("__part0", docs.doc_id)
    rows = {r.doc_id: r for r in decontaminate.contamination(extra, items)
            .withColumn("kept", decontaminate.without_hits()).collect()}
    assert rows[1].kept == "x y" and rows[2].kept == "clean" and rows[3].kept is None
    assert rows[1]["__part0"] == 1 and [tuple(s) for s in rows[1].contamination.spans] == [(2, 15)]
    assert found(decontaminate.contamination(docs, items.limit(0)))[1] == (5, 0, [])
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_windows_of_unspaced_words_count(spark):
    pieces = list(decontaminate._pieces(".".join(f"w{i}" for i in range(5000)), 10, 500))
    assert sum(n for _, n in pieces) == 4991 and max(n for _, n in pieces) == 500
    assert pieces[0][0].endswith(".w508") and pieces[1][0].startswith("w500.")
    assert list(decontaminate._pieces("", 10, 500)) == [("", 1)] and list(decontaminate._pieces("?a b!", 10, 500)) == [("a b", 1)]
    docs, items = make(spark, [(1, "w3 w4 w5 w6"), (2, "w9 w8 w7")], [(1, ".".join(f"w{i}" for i in range(40)))])
    assert found(decontaminate.contamination(docs, items, n_words=3, max_windows=2)) == {1: (4, 4, ["1"]), 2: (3, 0, [])}
