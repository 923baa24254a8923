import pytest
from pyspark.sql import functions as F

from gonggo.functions import regex as R
from gonggo.operators import urgency as U
from gonggo.operators import urgency_words as W
from gonggo.plans import model_queries, urgency_queries

TEXTS = ["접수 기간 2026. 6. 9(화) ~ 2026. 7. 9(목) 채용 시 마감 급구 다수 모집", "모집인원 3 명 마감일 상시채용 긴급 채용 조기 마감 0 to 1 팀",
         "업무 안내 빠르게 성장 애자일 팀 확장", "", None, "접수기간 · 방법 시작일 2026.06.09(화) 마감일 2026.07.09(목) 즉시 입사 결원", "즉시 합류 7명 모집 합격 축하금"]
SCHEMA = "row_id long, source string, raw_text string, final_techs array<string>, hard_skills array<string>"


def corpus(spark):
    return spark.createDataFrame([(i, ("jobkorea", "saramin", "wanted")[i % 3], t, ["Go"], []) for i, t in enumerate(TEXTS * 2)], SCHEMA)


def counted(spark, monkeypatch, module):
    """The corpus as the postings of `module`, and how many of its rows were made."""
    made = spark.sparkContext.accumulator(0)

    def seen(text):
        made.add(1)
        return text
    rows = corpus(spark).withColumn("raw_text", F.udf(seen)("raw_text"))
    monkeypatch.setattr(module, "postings", lambda spark, sf_dir: rows)
    return made


def test_quick_patterns_find_the_same(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    patterns = [v for n, v in vars(W).items() if isinstance(v, str) and n.isupper()] + [p for _, p, _ in W.VOCABULARY] + [r"(?i)ASAP|x?", r"a{0,2}b|c+"]
    t = F.col("t")
    for p in patterns:
        for f in (R.found, lambda *a, **k: R.first(*a, 0, **k), R.every):
            assert df.select(f(t, p)).collect() == df.select(f(t, p, quick=True)).collect(), p
    assert R.words_needed(r"급구|긴급\s*채용") == ("급구", "긴급") and R.words_needed(r"a?|b") == () and R.words_needed("(?i)ab") == ()


@pytest.mark.parametrize("measurable", [True, False])
def test_postings_left_out_early_are_the_same(spark, monkeypatch, measurable):
    monkeypatch.setattr(model_queries, "postings", lambda spark, sf_dir: corpus(spark))
    early = model_queries.labelled(spark, None, measurable).collect()
    late = model_queries.labelled(spark, None).where(F.col("measurable") == measurable).collect()
    assert early and sorted(early) == sorted(late)


def test_known_vocabulary_gives_the_same_labels(spark):
    new = U.score_postings(corpus(spark), keep_inner=True).select(*corpus(spark).columns, "measurable", "vocabulary")
    names = ["row_id", "urgency_score", "urgency_reason", "evidence_score", "measurable"]
    assert (sorted(U.score_postings(new, pack=U.V2, known=True).select(names).collect())
            == sorted(U.score_postings(corpus(spark), pack=U.V2).select(names).collect()))


def test_label_history_labels_each_posting_once(spark, monkeypatch):
    made = counted(spark, monkeypatch, model_queries)
    assert model_queries.label_history(spark, None).count() == 6 and made.value == len(TEXTS) * 2


def test_posting_percentiles_label_each_posting_once(spark, monkeypatch):
    made = counted(spark, monkeypatch, urgency_queries)
    assert len(urgency_queries.posting_percentiles(spark, None).collect()) == len(TEXTS) * 2 and made.value == len(TEXTS) * 2
