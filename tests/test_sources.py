"""Reading files, mapping experience, parsing pages."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from gonggo.sources import pages as G
from gonggo.sources import postings as S


def test_experience_levels(spark):
    wanted = {None: "경력무관", "": "경력무관", "협의": "경력무관", "0": "신입", "-1": "신입", "2.9": "1~3년차",
              "3": "3~5년차", "5.0": "5년이상", "nan": "5년이상"}
    jobkorea = {None: "경력무관", "  ": "경력무관", "신입": "신입", "신입·경력": "경력무관", "경력": "경력무관",
                "경력 2년↑": "1~3년차", "경력(4 년)": "3~5년차", "10년": "5년이상", "무관": "경력무관"}
    for cases, fn in ((wanted, S.wanted_level), (jobkorea, S.jobkorea_level)):
        df = spark.createDataFrame(list(cases.items()), "v string, e string")
        assert [r for r in df.select("v", "e", fn(F.col("v")).alias("g")).collect() if r["g"] != r["e"]] == []


def test_ingest_write_read(spark, tmp_path):
    lists = {c: ["a"] for c in S.LIST_COLUMNS}
    files = {
        "wanted_cleaned_techs2.json": [{"job_id": 1, "company": "c", "position": "p", "year_filter": 3.0,
                                        "main_tasks": "m", "requirements": "", "preferred": "q", **lists}],
        "jobkorea_cleaned_techs2.json": [{"공고번호": "2", "회사명": "d", "연차/경력": "신입", "상세내용": "x", **lists}],
        "saramin_cleaned_techs2.json": [{"공고번호": "3", "원문": "y", **lists}, {"공고번호": "3", "원문": "z", **lists}]}
    for name, rows in files.items():
        (tmp_path / name).write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    master = S.ingest(spark, str(tmp_path))
    S.write_master(master, str(tmp_path / "out"), "raw")
    back = S.read_master(spark, str(tmp_path / "out"), "raw").orderBy("row_id").collect()
    assert [(r["source"], r["job_id"], r["raw_text"], r["experience_level"]) for r in back] == [
        ("wanted", "1", "m\n\nq", "3~5년차"), ("jobkorea", "2", "x", "신입"),
        ("saramin", "3", "y", None), ("saramin", "3", "z", None)]
    assert [r["row_id"] for r in back] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        S.master_path("x", "v9")


def test_row_numbers_are_dense_whatever_the_pieces(spark, tmp_path):
    for name, key in (("wanted", "job_id"), ("jobkorea", "공고번호"), ("saramin", "공고번호")):
        folder = tmp_path / f"{name}_cleaned_techs2.json"
        folder.mkdir()
        for part, n in (("a", 700), ("b", 0), ("c", 40)):
            (folder / f"part-{part}.json").write_text("".join(json.dumps({key: f"{part}{i}", "note": "x" * 50}) + "\n" for i in range(n)), encoding="utf-8")
    ids = []
    for size in ("134217728", "4096"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = S.ingest(spark, str(tmp_path), lines=True).select("row_id", "source", "job_id").orderBy("row_id").collect()
        ids.append(rows)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ids[0] == ids[1] and [r["row_id"] for r in ids[0]] == list(range(2220))
    assert [(r["source"], r["job_id"]) for r in ids[0]] == [
        (s, f"{p}{i}") for s in ("wanted", "jobkorea", "saramin") for p, n in (("a", 700), ("c", 40)) for i in range(n)]


def test_versions(spark, tmp_path):
    rows = [(i, s, str(i), None, None, None, None, f"{v} {i}", [], [], [], [], [], i, None) for v in ("x",) for i, s in enumerate(["wanted", "saramin", "saramin"])]
    df = spark.createDataFrame(rows, S.MASTER)
    folder = str(tmp_path)
    S.write_version(df, folder, "raw")
    S.write_version(df, folder, "v5")
    S.write_version(df.where("source = 'saramin' AND row_id = 1").withColumn("raw_text", F.lit("new")), folder, "v5")
    got = {v: sorted((r["row_id"], r["raw_text"]) for r in S.read_version(spark, folder, v).collect()) for v in ("raw", "v5")}
    assert got == {"raw": [(0, "x 0"), (1, "x 1"), (2, "x 2")], "v5": [(0, "x 0"), (1, "new")]}
    for unknown in ("v9", "v4"):
        with pytest.raises(ValueError):
            S.read_version(spark, folder, unknown)


def test_list_cells(spark):
    cases = {"['a', 'b']": ["a", "b"], '["it\'s"]': ["it's"], "[]": [], "[1, 2]": [], "['a'": [], None: [], "x": []}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["g"] for r in df.select("v", S.parse_list(F.col("v")).alias("g")).collect()}
    assert got == cases


def test_addresses(spark):
    cases = {"https://www.jobkorea.co.kr/Recruit/GI_Read/123?x=1": ("jobkorea", "123", None),
             "m.saramin.co.kr/job?rec_idx=9&b=2": ("saramin", "9", None),
             "https://www.saramin.co.kr/rec_idx/77": ("saramin", "77", None),
             "https://www.wanted.co.kr/wd/5": ("wanted", "5", None),
             "https://www.wanted.co.kr/company/5": (None, None, "no_job_id"),
             "https://example.com/wd/5": (None, None, "unsupported_site"), "": (None, None, "unsupported_site")}
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    got = {r["url"]: (r["source"], r["job_id"], r["detect_error"]) for r in G.detect(df).collect()}
    assert got == cases


def test_page_pieces(spark):
    html = ('<TITLE>[회사] 제목 &lt;x&gt; (D-3) - 사람인</TITLE><meta name="description" content="회사, 백엔드, 신입, 경력:무관, '
            '학력:대졸, 마감일:2026-07-01"/><Script>a</sCRIPT><p>본문&nbsp; 글</p>')
    df = spark.createDataFrame([("1", html, "<b>지역</b> 서울 강남구 논현동"), ("2", None, None), ("3", "<p>x</p>", None)],
                               "job_id string, html string, mobile_html string")
    rows = {r["job_id"]: r for r in G.backfill_fields(df).collect()}
    assert rows["1"].asDict() == {"job_id": "1", "title": "백엔드, 신입", "company": "회사", "experience_level": "무관",
                                  "education": "대졸", "deadline": "2026-07-01", "location": "서울 강남구", "status": "ok"}
    assert (rows["2"]["status"], rows["3"]["status"]) == ("not_found", "parse_failed")
    text = df.select(G.page_text(F.col("html")).alias("t")).first()["t"]
    assert text == "[회사] 제목 <x> (D-3) - 사람인 본문 글"


def test_pasted_text(spark):
    df = spark.createDataFrame([(" 마감일 ： 2026-07-01 글 ",)], "text string")
    row = G.from_text(df).first()
    assert row["deadline"] == datetime.date(2026, 7, 1) and row["raw_text"].startswith("마감일")


def test_chrome_is_cut_only_when_enough_remains(spark):
    long, short = "메뉴 취업톡톡 " + "가" * 200, "메뉴 취업톡톡 " + "가" * 199
    df = spark.createDataFrame([(long,), (short,)], "t string")
    got = [r[0] for r in df.select(G.strip_chrome(F.col("t"), "jobkorea")).collect()]
    assert got == ["가" * 200, short]
