"""The urgency rule on literal postings."""

from pyspark.sql import functions as F

from gonggo.operators import urgency as U

WIN_A = "접수기간 · 방법 시작일 2026.06.09(화) 마감일 2026.07.09(목)"
WIN_B = "접수기간 2026. 6. 9(화) ~ 2026. 7. 9(목)"
TAIL = ("㈜우리회사 백엔드 개발자 모집 상세요강 접수기간∙방법 기업정보 추천공고 " + "본문입니다 " * 40 +
        "AI추천공고를 확인해 보세요! ㈜다른회사 프론트엔드 채용 프론트엔드개발자 상시채용 즉시 지원")
PRIVACY = ("모집분야 백엔드 " + "본문 " * 40 + "* 본 입사지원서 상의 개인정보는 [개인정보 보호법] 제15조에 의거하여 "
           "당사 상시 채용을 위한 용도로만 사용됩니다")
STATS = f"{WIN_A} 지원자 현황 통계 지원자 수 8 명 모집인원 "

# name -> (text, source, expected evidence)
EVIDENCE = {
    "rolling phrase counts once, block": (f"{WIN_A} 채용 시 마감 접수방법 즉시지원", "x", 16),
    "rolling phrase counts once, period": (f"{WIN_B} 채용 시 마감 접수방법 온라인", "x", 16),
    "early close alone": (f"{WIN_A} 접수방법 즉시지원 조기 마감될 수 있습니다", "x", 16),
    "rolling alone": (f"{WIN_A} 채용시까지 접수방법", "x", 14),
    "always open": ("모집인원 1 명 마감일 상시채용 접수방법 온라인", "x", 10),
    "applicants are no headcount": (STATS + "○○ 명", "jobkorea", 4),
    "headcount after applicants": (STATS + "12 명", "jobkorea", 32),
    "days remaining do not count": ("접수기간 · 방법 남은기간 3일 접수방법 즉시지원", "x", 0),
    "zero headcount falls to many": ("모집인원 0 명 다수 채용", "x", 12),
    "huge headcount": ("모집인원 99999999999999999999 명", "x", 28),
    "wide blanks": ("접수　기간 2026. 6. 9 ~ 2026. 6. 11 급구", "x", 62),
    "impossible date": ("접수기간 · 방법 시작일 2026.02.30(화) 마감일 2026.07.09(목) 급구", "x", 32),
    "window over 400 days": ("시작일 2025.01.01 마감일 2026.07.09", "x", 0),
}
ALWAYS_OPEN = {
    "지원자격 경력 경력 접수기간 · 방법 시작일 2026.05.06(수) 마감일 상시채용 접수방법 잡코리아 즉시지원": True,
    "전형절차 접수기간 및 방법 ㆍ접수기간 : 상시모집 ㆍ접수방법 : 사람인 입사지원": True,
    "㈜윈스테크넷 상시채용(신입) - 보안 솔루션 개발 상세요강 접수기간∙방법 기업정보 추천공고": True,
    TAIL: False,
    PRIVACY: False,
    "㈜회사 채용 상세요강 접수기간∙방법 기업정보 추천공고 " + "안내 " * 30 +
    "접수기간 · 방법 시작일 2026.06.08(월) 마감일 상시채용 접수방법 홈페이지": True,
    "": False,
}


def scored(spark, rows, pack=U.V5):
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)],
                               "row_id long, raw_text string, source string")
    out = U.score_postings(df, pack=pack, keep_inner=True).orderBy("row_id")
    return out.collect()


def test_evidence(spark):
    got = scored(spark, [(t, s) for t, s, _ in EVIDENCE.values()])
    assert {n: r["evidence"] for n, r in zip(EVIDENCE, got)} == {n: e for n, (_, _, e) in EVIDENCE.items()}
    assert "채용 시 마감(충원되면 조기 종료)" in got[0]["signal_reasons"]


def test_always_open(spark):
    df = spark.createDataFrame([(t, e) for t, e in ALWAYS_OPEN.items()], "t string, e boolean")
    assert df.where(U.is_always_open(F.col("t")) != F.col("e")).count() == 0


def test_window_is_the_same_quantity_in_both_forms(spark):
    far = f"{WIN_A} 모집인원 1 명 " + "우리 회사는 성장 중입니다 " * 3 + "채용 시 마감이라는 말이 본문에 있음"
    a, b, c = scored(spark, [(WIN_A, "x"), (WIN_B, "x"), (far, "x")])
    assert (a["window_days"], b["window_days"]) == (30, 30)
    assert c["rolling"] is False


def test_scoring_uses_the_anchored_phrase(spark):
    real = ("㈜우리회사 백엔드 개발자 모집 지원자격 경력 경력 접수기간 · 방법 마감일 상시채용 접수방법 잡코리아 즉시지원")
    a, b = scored(spark, [(real, "jobkorea"), (TAIL, "jobkorea")])
    assert "상시" in a["urgency_reason"] and "상시" not in b["urgency_reason"]


def test_fallback(spark):
    rows = scored(spark, [
        ("백엔드 개발자를 찾습니다. Python 경험자 우대.", "wanted"),
        ("급성장하는 조직입니다. 애자일하게 일하며 빠른 성장을 지향합니다. 신규 팀의 초기 멤버를 찾습니다.", "wanted"),
        (f"{WIN_A} 접수방법", "jobkorea"), (None, "wanted")])
    assert rows[0]["urgency_score"] == 2 and rows[0]["measurable"] is False
    assert rows[0]["evidence_score"] is None
    assert "기준점" in rows[0]["urgency_reason"] and "중립" not in rows[0]["urgency_reason"]
    assert rows[1]["vocabulary"] and rows[1]["urgency_score"] <= 3
    assert rows[2]["measurable"] is True and rows[3]["urgency_score"] == 2


def test_fallback_rounds_half_up_and_clips(spark):
    cases = [(2, 1, 2), (6, 2, 4), (100, 2, 5), (0, 0, 1)]
    df = spark.createDataFrame(cases, "a int, b int, e int")
    assert df.where(U.fallback_level(F.col("a"), F.col("b"), 0.25) != F.col("e")).count() == 0


def test_version_2_counts_days_left_and_both_phrases(spark):
    rows = scored(spark, [("접수기간 남은기간 3일", "x"), (f"{WIN_B} 채용 시 마감", "x"),
                          ("소개 글", "wanted"), ("모집인원 3 명 " + "글 " * 200 + "상시 채용", "x")], U.V2)
    assert [r["evidence"] for r in rows] == [35, 4 + 10 + 12, 0, 11 + 10]
    assert rows[2]["urgency_score"] == 3 and "중립" in rows[2]["urgency_reason"]


def test_newer_rule_never_scores_higher_on_the_same_phrase(spark):
    texts = [(f"{WIN_B} {p}", "saramin") for p in ("채용 시 마감", "조기 마감", "급구 충원", "다수 모집")]
    new, old = scored(spark, texts), scored(spark, texts, U.V2)
    assert all(a["evidence"] <= b["evidence"] for a, b in zip(new, old))


def test_filter_on_a_score_keeps_the_plan_small(spark):
    df = spark.createDataFrame([(1, WIN_A, "x")], "row_id long, raw_text string, source string")
    plan = U.score_postings(df).where("urgency_score >= 2 and measurable")._jdf.queryExecution() \
        .optimizedPlan().toString()
    assert plan.count("축하금") == 3          # twice in the one pattern, once in its label


def test_label_versions_must_hold_the_same_rows(spark):
    import pytest
    a = spark.createDataFrame([(1, "s", "j"), (2, "s", "j")], "row_id long, source string, job_id string")
    U.assert_aligned(a, a)
    with pytest.raises(ValueError):
        U.assert_aligned(a, a.where("row_id = 1"))


def test_structured_features(spark):
    df = spark.createDataFrame([(1, f"{WIN_A} 급구", "x"), (2, "", "x")],
                               "row_id long, raw_text string, source string")
    a, b = U.structured_features(df).orderBy("row_id").collect()
    assert (a["f_window_days"], a["f_window_missing"], a["f_is_urgent_word"], a["f_headcount"]) == (30, 0, 1, -1)
    assert (b["f_window_days"], b["f_window_missing"], b["f_headcount_missing"]) == (-1, 1, 1)
