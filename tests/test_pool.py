"""Deadlines, statuses and the recommendation pool."""

import datetime

import pytest

from pyspark.sql import functions as F

from gonggo.operators import pool as P
from tests.test_urgency import PRIVACY, TAIL

AS_OF = "2026-06-20"
STATUS = {
    "접수기간 상시채용 접수방법 온라인 입사지원": "rolling",
    "접수기간 · 방법 시작일 2026.06.08(월) 마감일 상시채용 접수방법 잡코리아 즉시지원": "rolling",
    "접수기간 채용 시 마감 접수방법 온라인": "rolling",
    TAIL: "unknown", PRIVACY: "unknown",
    "접수기간 · 방법 시작일 2026.06.01(월) 마감일 2026.07.09(목)": "open",
    "접수기간 · 방법 시작일 2026.04.01(수) 마감일 2026.05.09(토)": "closed",
    "회사 소개와 복지만 적혀 있고 접수 조건이 없는 공고": "unknown",
    "접수기간 · 방법 시작일 2026.06.01(월) 마감일 2026.07.09(목) 채용 시 마감": "open",
    "접수기간 2026/6/1 ~ 2026/6/19": "closed", "접수기간 2026/6/1 ~ 2026/6/20": "open",
}


def test_statuses(spark):
    df = spark.createDataFrame(list(STATUS.items()), "raw_text string, e string")
    got = P.with_deadline(df).withColumn(
        "s", P.status_of(F.col("deadline"), F.col("rolling"), P.day(AS_OF)))
    assert [r for r in got.collect() if r["s"] != r["e"]] == []
    last = got.where(F.col("raw_text").contains("2026.07.09(목) 채용 시 마감")).first()
    assert last["deadline"] == datetime.date(2026, 7, 9) and last["rolling"] is True


ROW = ("row_id long, source string, job_id string, title string, company string, location string, "
       "experience_level string, raw_text string, techs array<string>, skills_extra array<string>")


def corpus(spark):
    return spark.createDataFrame([
        (1, "saramin", "7", None, "nan", None, None, "마감일 2026.01.01", ["Java"], []),
        (2, "saramin", "8", None, None, None, None, "글", [], []),
        (3, "jobkorea", "7", "t", "c", "서울", "신입", "접수기간 상시채용", [], ["엑셀"]),
        (4, "jobkorea", "7", "t2", "c", None, None, "마감일 2026.12.01", ["Go"], []),
    ], ROW)


SIDE = "job_id string, title string, company string, experience_level string, location string, deadline string, status string"


def test_backfill_fills_only_blank_saramin_fields(spark):
    side = spark.createDataFrame([("7", "제목", "회사", "신입", None, "2026-07-01", "ok"),
                                  ("8", "x", "y", None, None, None, "parse_failed")], SIDE)
    rows = {r["row_id"]: r for r in P.recommendation_pool(corpus(spark), AS_OF, side).collect()}
    assert set(rows) == {1, 3, 4}
    assert (rows[1]["title"], rows[1]["company"], rows[1]["status"]) == ("제목", "회사", "open")
    assert rows[1]["deadline"] == datetime.date(2026, 7, 1) and rows[1]["rolling"] is False
    assert (rows[3]["title"], rows[3]["status"], rows[4]["status"]) == ("t", "rolling", "open")


def test_pool_options_and_warnings(spark):
    whole = corpus(spark)
    pool = P.recommendation_pool(whole, AS_OF, None)
    assert [r["row_id"] for r in pool.orderBy("row_id").collect()] == [3, 4]
    stage, seen = P.guarded_pool(whole, AS_OF)
    assert stage.count() == pool.count() and seen["warning"] == P.NO_BACKFILL
    assert (seen["rows"], seen["merged"], seen["unnamed"]) == (whole.count(), 0, whole.count() - pool.count())
    assert [r["row_id"] for r in P.recommendation_pool(
        whole, AS_OF, None, True, True, ["jobkorea"]).collect()] == [4]
    empty = spark.createDataFrame([("99", "a", "b", None, None, None, "ok")], SIDE)
    with pytest.raises(ValueError):
        P.guarded_pool(whole, AS_OF, empty)
    side = spark.createDataFrame([("7", "제목", "회사", None, None, None, "ok")], SIDE)
    assert P.guarded_pool(whole, AS_OF, side)[1]["merged"] >= 1
    assert P.duplicate_keys(whole).first()["repeats"] == 1
