"""The urgency rule over the whole corpus, step by step and as reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gonggo.operators import urgency as U
from gonggo.operators import urgency_words as W
from gonggo.plans.corpus import over_corpus, postings
from gonggo.plans.registry import query
from gonggo.session import cut_lineage


def labelled(spark, sf_dir, pack: U.RulePack = U.V5, keep_inner: bool = False) -> DataFrame:
    return U.score_postings(postings(spark, sf_dir), pack=pack, keep_inner=keep_inner)


# ---------------------------------------------------------------- the rule in SQL

def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


def _cut(column: str) -> str:
    for marker in W.TAIL_MARKERS:
        column = f"split_part({column}, '{marker}', 1)"
    return f"regexp_replace({column}, '{W.DISCLAIMER}', ' ', 'g')"


def _date(column: str, pattern: str, a: int, b: int, c: int) -> str:
    part = [f"regexp_extract({column}, '{pattern}', {g})" for g in (a, b, c)]
    return f"CAST(try_strptime({part[0]} || '-' || {part[1]} || '-' || {part[2]}, '%Y-%m-%d') AS DATE)"


def _valid_days(a: str, b: str) -> str:
    return f"CASE WHEN date_diff('day', {a}, {b}) BETWEEN 0 AND 400 THEN date_diff('day', {a}, {b}) END"


def _always_open(column: str) -> str:
    hit = f"regexp_matches(w, '{W.ALWAYS_OPEN}') AND NOT regexp_matches(w, '{W.ALWAYS_OPEN_DENIED}')"
    fields = " OR ".join(
        f"len(list_filter(regexp_extract_all({column}, '{p}', 1), lambda w: {hit})) > 0"
        for p in W.ALWAYS_OPEN_FIELDS)
    title = f"regexp_extract(substr({column}, 1, {W.TITLE_CHARS}), '(?s)^(.*?)(?:상세요강|추천공고|$)', 1)"
    return f"({fields} OR ({hit.replace('(w,', '(' + title + ',')}))"


_ADD = " + ".join(f"CASE WHEN {_has('raw_text', p)} THEN {w} ELSE 0 END" for _, p, w in W.VOCABULARY)
_VOCABULARY = "list_filter([" + ", ".join(
    f"CASE WHEN {_has('raw_text', p)} THEN '{n}' END" for n, p, _ in W.VOCABULARY) + "], lambda x: x IS NOT NULL)"
_NAMES = "CASE urgency_score " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in W.LEVEL_NAMES.items()) + " END"


def rule_sql(v5: bool = True) -> tuple[str, ...]:
    """The rule as named SQL steps; the last one is `scored`."""
    body = _cut("raw_text")
    if v5:
        body = f"regexp_replace({body}, '{W.APPLICANT_STATS}', ' ', 'g')"
    block = f"regexp_extract(body, '{W.START_END}(?s:.{{0,40}})', 0)" if v5 else "''"
    opened = _always_open("body") if v5 else _has("body", W.ALWAYS_OPEN)
    left = "TRY_CAST(regexp_extract(raw_text, '" + W.DAYS_LEFT + "', 1) AS INTEGER)" if not v5 \
        else "CAST(NULL AS INTEGER)"
    steps = [
        f"bodies AS (SELECT *, CASE WHEN source = 'jobkorea' THEN {body} ELSE raw_text END AS body FROM postings)",
        f"""segments AS (SELECT *, regexp_extract(body, '{W.PERIOD}', 1) AS period, {block} AS block,
            {_has('body', '접수[ ]*기간')} AS has_period FROM bodies)""",
        f"""dated AS (SELECT *, {_date('block', W.START_END, 1, 2, 3)} AS a_start,
            {_date('block', W.START_END, 4, 5, 6)} AS a_end,
            regexp_extract_all(period, '{W.DATE}', 0) AS ds FROM segments)""",
        f"""ranged AS (SELECT *, {_valid_days('a_start', 'a_end')} AS a_days,
            {_date('ds[1]', W.DATE, 1, 2, 3)} AS b_start, {_date('ds[2]', W.DATE, 1, 2, 3)} AS b_end FROM dated)""",
        f"""windows AS (SELECT *, {_valid_days('b_start', 'b_end')} AS b_days,
            coalesce(a_days, {_valid_days('b_start', 'b_end')}) AS window_days,
            CASE WHEN a_days IS NOT NULL THEN {_has('block', W.ROLLING)} ELSE {_has('period', W.ROLLING)} END AS rolling,
            CASE WHEN a_days IS NOT NULL THEN a_end WHEN {_valid_days('b_start', 'b_end')} IS NOT NULL THEN b_end END AS window_end
            FROM ranged)""",
        f"""signals AS (SELECT *, {left} AS days_left,
            TRY_CAST(coalesce(nullif(regexp_extract(body, '{W.HEADCOUNT}', 1), ''),
                     nullif(regexp_extract(body, '{W.HEADCOUNT_LOOSE}', 1), '')) AS BIGINT) AS headcount,
            {_has('body', W.MANY)} AS is_many, {_has('body', W.EARLY_CLOSE)} AS is_early_close,
            {opened} AS is_always_open, {_has('body', W.URGENT)} AS is_urgent,
            {_has('body', W.IMMEDIATE)} AS is_immediate, {_has('body', W.BACKFILL)} AS is_backfill,
            {_has('body', W.BONUS)} AS is_bonus, {_has('raw_text', W.META_SECTION)} AS measurable,
            {_ADD} AS vocabulary_points, {_VOCABULARY} AS vocabulary FROM windows)"""]
    window_points = """CASE WHEN window_days <= 3 THEN 30 WHEN window_days <= 7 THEN 22
        WHEN window_days <= 14 THEN 12 WHEN window_days <= 30 THEN 4 ELSE 0 END"""
    window_reason = """CASE WHEN window_days <= 3 THEN '접수 ' || window_days || '일(초단기 모집)'
        WHEN window_days <= 7 THEN '접수 ' || window_days || '일(단기)'
        WHEN window_days <= 30 THEN '접수 ' || window_days || '일'
        WHEN window_days IS NOT NULL THEN '접수 ' || window_days || '일(장기)' END"""
    rolls = "rolling AND NOT is_early_close" if v5 else "rolling"
    opens = "NOT rolling AND window_days IS NULL AND is_always_open"
    early = ("CASE WHEN is_early_close THEN CASE WHEN rolling THEN '" + W.ROLLING_REASON + "' ELSE '"
             + W.EARLY_CLOSE_REASON + "' END END") if v5 else \
        f"CASE WHEN is_early_close THEN '{W.EARLY_CLOSE_REASON}' END"
    steps += [
        f"""evidence AS (SELECT *, {window_points} + CASE WHEN {rolls} THEN 10 ELSE 0 END
              + CASE WHEN {opens} THEN 10 ELSE 0 END
              + CASE WHEN headcount >= 10 THEN 28 WHEN headcount >= 5 THEN 20 WHEN headcount >= 2 THEN 11
                     WHEN headcount = 1 THEN 0 WHEN is_many THEN 12 ELSE 0 END
              + CASE WHEN is_urgent THEN 32 ELSE 0 END + CASE WHEN is_immediate THEN 22 ELSE 0 END
              + CASE WHEN is_backfill THEN 16 ELSE 0 END + CASE WHEN is_early_close THEN 12 ELSE 0 END
              + CASE WHEN is_bonus THEN 12 ELSE 0 END AS evidence,
            list_filter([{window_reason}, CASE WHEN {rolls} THEN '{W.ROLLING_REASON}' END,
              CASE WHEN {opens} THEN '{W.ALWAYS_OPEN_REASON}' END,
              CASE WHEN headcount >= 10 THEN '모집인원 ' || headcount || '명(대규모)'
                   WHEN headcount >= 2 THEN '모집인원 ' || headcount || '명'
                   WHEN headcount = 1 THEN NULL WHEN is_many THEN '다수 모집' END,
              CASE WHEN is_urgent THEN '급구·긴급 채용 명시' END,
              CASE WHEN is_immediate THEN '즉시 입사·투입 요구' END,
              CASE WHEN is_backfill THEN '결원·충원 목적' END, {early},
              CASE WHEN is_bonus THEN '합격축하금 등 보상 유인' END], lambda x: x IS NOT NULL) AS signal_reasons
            FROM signals)""",
        f"""levels AS (SELECT *, CASE WHEN NOT measurable
              THEN greatest(1, least(5, CAST(floor({'2 + vocabulary_points * 0.25' if v5 else '3 + vocabulary_points'} + 0.5) AS INTEGER)))
              WHEN evidence <= 0 THEN 1 WHEN evidence <= 14 THEN 2 WHEN evidence <= 26 THEN 3
              WHEN evidence <= 42 THEN 4 ELSE 5 END AS urgency_score,
            CASE WHEN measurable THEN signal_reasons ELSE vocabulary END AS reasons,
            CASE WHEN measurable THEN evidence END AS evidence_score FROM evidence)""",
        f"""scored AS (SELECT *, CASE
              WHEN NOT measurable AND len(reasons) = 0 THEN '적극성 ' || {_NAMES}
                || {"' — 마감·모집 규모 정보가 없어 측정할 수 없고 본문에 긴급 어휘도 없다. 관측이 아니라 기준점(' || urgency_score || '점)을 부여한 값이다'" if v5 else "'(중립) — 마감·모집 규모 정보가 없고 본문에 긴급 관련 어휘도 없어 기준점 부여'"}
              WHEN NOT measurable THEN '적극성 ' || {_NAMES} || '{W.REASON_VOCABULARY['v5' if v5 else 'v2'][0]}'
                || array_to_string(reasons, ' · ') || '{W.REASON_VOCABULARY['v5' if v5 else 'v2'][1]}'
              WHEN len(reasons) = 0 THEN '적극성 ' || {_NAMES} || ' — {W.REASON_NO_SIGNAL['v5' if v5 else 'v2']}'
              ELSE '적극성 ' || {_NAMES} || ' — ' || array_to_string(reasons, ' · ') END AS urgency_reason FROM levels)"""]
    return tuple(steps)


V5_SQL, V2_SQL = rule_sql(True), rule_sql(False)


# ---------------------------------------------------------------- steps

@query("clean_bodies", over_corpus("SELECT row_id, body FROM bodies", *V5_SQL[:1]))
def clean_bodies(spark, sf_dir):
    return U.with_body(postings(spark, sf_dir)).select("row_id", "body")


@query("always_open", over_corpus("SELECT row_id, is_always_open FROM signals", *V5_SQL[:6]))
def always_open(spark, sf_dir):
    rows = U.with_body(postings(spark, sf_dir))
    return rows.select("row_id", U.is_always_open(F.col("body")).alias("is_always_open"))


@query("application_windows", over_corpus(
    "SELECT row_id, window_days, rolling, window_end FROM windows", *V5_SQL[:5]))
def application_windows(spark, sf_dir):
    return U.with_window(U.with_body(postings(spark, sf_dir))).select(
        "row_id", "window_days", "rolling", "window_end")


@query("urgency_signals", over_corpus(
    """SELECT row_id, evidence, array_to_string(signal_reasons, ' · ') AS reasons, headcount, is_many,
       is_urgent, is_immediate, is_backfill, is_early_close, is_bonus FROM evidence""", *V5_SQL[:7]))
def urgency_signals(spark, sf_dir):
    return U.signal_table(postings(spark, sf_dir)).select(
        "row_id", "evidence", F.concat_ws(" · ", "signal_reasons").alias("reasons"),
        F.col("headcount").cast("long").alias("headcount"), "is_many", "is_urgent",
        "is_immediate", "is_backfill", "is_early_close", "is_bonus")


_RESULT = """SELECT row_id, urgency_score, urgency_reason, evidence_score,
    array_to_string(reasons, ' · ') AS reasons, measurable, window_days, rolling, '{}' AS rule_version FROM scored"""


def _result(scored):
    return scored.select("row_id", "urgency_score", "urgency_reason", "evidence_score",
                         F.concat_ws(" · ", "reasons").alias("reasons"), "measurable",
                         "window_days", "rolling", "rule_version")


@query("urgency_scores", over_corpus(_RESULT.format("v5"), *V5_SQL))
def urgency_scores(spark, sf_dir):
    return _result(labelled(spark, sf_dir))


@query("urgency_scores_v2", over_corpus(_RESULT.format("v2"), *V2_SQL))
def urgency_scores_v2(spark, sf_dir):
    return _result(labelled(spark, sf_dir, U.V2))


@query("vocabulary_evidence", over_corpus(
    """SELECT row_id, vocabulary_points AS points, array_to_string(vocabulary, ' · ') AS hits,
       greatest(1, least(5, CAST(floor(2 + vocabulary_points * 0.25 + 0.5) AS INTEGER))) AS level FROM signals""",
    *V5_SQL[:6]))
def vocabulary_evidence(spark, sf_dir):
    hits = postings(spark, sf_dir).select("row_id", U.vocabulary_hits(F.col("raw_text")).alias("h"))
    points = U.vocabulary_points(F.col("h"))
    return hits.select("row_id", points.alias("points"), F.concat_ws(" · ", "h").alias("hits"),
                       U.fallback_level(points, 2, 0.25).alias("level"))


def _double(flag: str) -> str:
    return f"CASE WHEN {flag} THEN 1.0 ELSE 0.0 END"


@query("structured_features", over_corpus(
    f"""SELECT row_id, coalesce(CAST(window_days AS DOUBLE), -1.0) AS f_window_days,
        {_double('window_days IS NULL')} AS f_window_missing, {_double('rolling')} AS f_rolling,
        CASE WHEN headcount > 0 THEN CAST(headcount AS DOUBLE) ELSE -1.0 END AS f_headcount,
        {_double('NOT coalesce(headcount > 0, false)')} AS f_headcount_missing,
        {_double('is_urgent')} AS f_is_urgent_word, {_double('is_immediate')} AS f_is_immediate,
        {_double('is_backfill')} AS f_is_backfill, {_double('is_early_close')} AS f_is_early_close,
        {_double('is_bonus')} AS f_has_bonus, {_double('is_many')} AS f_is_many FROM signals""", *V5_SQL[:6]),
       DOUBLE=("f_window_missing", "f_rolling", "f_headcount_missing", "f_is_urgent_word", "f_is_immediate",
               "f_is_backfill", "f_is_early_close", "f_has_bonus", "f_is_many"))
def structured_features(spark, sf_dir):
    return U.structured_features(postings(spark, sf_dir)).select(
        "row_id", *("f_" + n for n in W.FEATURE_NAMES))


# ---------------------------------------------------------------- reports

_LEVEL_COUNTS = ", ".join(
    f"sum(CASE WHEN urgency_score = {i} THEN 1 ELSE 0 END) AS level_{i}" for i in range(1, 6))


@query("label_distribution", over_corpus(
    f"""SELECT source, count(*) AS n, {_LEVEL_COUNTS} FROM scored GROUP BY source
        UNION ALL SELECT NULL, count(*), {_LEVEL_COUNTS} FROM scored""", *V5_SQL),
       BIGINT=tuple(f"level_{i}" for i in range(1, 6)))
def label_distribution(spark, sf_dir):
    return U.label_distribution(labelled(spark, sf_dir))


@query("label_transitions", over_corpus(
    """SELECT old_label AS old_level, urgency_score AS new_level, count(*) AS n FROM scored
       WHERE old_label <> urgency_score GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 8""", *V5_SQL))
def label_transitions(spark, sf_dir):
    new = labelled(spark, sf_dir)
    old = postings(spark, sf_dir).select("row_id", "source", "job_id",
                                         F.col("old_label").alias("urgency_score"))
    return U.label_transitions(old, new, top=8)


_EVIDENCE_BY_PART = """parts_of AS (SELECT source, evidence FROM evidence
    UNION ALL SELECT NULL, evidence FROM evidence),
  placed AS (SELECT source, evidence, row_number() OVER (PARTITION BY source ORDER BY evidence) - 1 AS i,
    count(*) OVER (PARTITION BY source) AS total FROM parts_of)"""


@query("evidence_quantiles", over_corpus(
    """SELECT source, max(total) AS n, sum(CASE WHEN evidence = 0 THEN 1 ELSE 0 END) AS zero_rows,
       max(CASE WHEN i = least(CAST(floor(total * CAST(0.50 AS DOUBLE)) AS BIGINT), total - 1) THEN evidence END) AS p50,
       max(CASE WHEN i = least(CAST(floor(total * CAST(0.75 AS DOUBLE)) AS BIGINT), total - 1) THEN evidence END) AS p75,
       max(CASE WHEN i = least(CAST(floor(total * CAST(0.90 AS DOUBLE)) AS BIGINT), total - 1) THEN evidence END) AS p90,
       max(evidence) AS max_evidence FROM placed GROUP BY source""", *V2_SQL[:7], _EVIDENCE_BY_PART),
       BIGINT=("zero_rows",))
def evidence_quantiles(spark, sf_dir):
    return U.evidence_quantiles(U.signal_table(postings(spark, sf_dir), pack=U.V2)
                                .select("source", "evidence"))


@query("evidence_buckets", over_corpus(
    "SELECT bucket, count(*) AS n FROM (SELECT CASE " + " ".join(
        f"WHEN evidence BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in U.BUCKETS)
    + " END AS bucket FROM evidence) WHERE bucket IS NOT NULL GROUP BY bucket", *V2_SQL[:7]))
def evidence_buckets(spark, sf_dir):
    return U.evidence_buckets(U.signal_table(postings(spark, sf_dir), pack=U.V2))


@query("reference_stats", over_corpus(
    f"""SELECT 'source:' || source AS part, count(*) AS n, {_LEVEL_COUNTS} FROM scored GROUP BY source
        UNION ALL SELECT 'overall', count(*), {_LEVEL_COUNTS} FROM scored
        UNION ALL SELECT 'measurable', count(*), {_LEVEL_COUNTS} FROM scored WHERE measurable""", *V5_SQL),
       BIGINT=tuple(f"level_{i}" for i in range(1, 6)))
def reference_stats(spark, sf_dir):
    return U.reference_stats(labelled(spark, sf_dir))


@query("window_percentiles", over_corpus(
    "SELECT count(*) AS window_n, " + ", ".join(
        f"CAST(trunc(quantile_cont(window_days, {p / 100})) AS INTEGER) AS p{p}" for p in (10, 25, 50, 75, 90))
    + " FROM scored WHERE measurable AND window_days IS NOT NULL", *V5_SQL))
def window_percentiles(spark, sf_dir):
    return U.window_percentiles(labelled(spark, sf_dir))


_LEVEL_ROWS = """level_rows AS (SELECT source, urgency_score, count(*) AS k FROM scored GROUP BY 1, 2
    UNION ALL SELECT NULL, urgency_score, count(*) FROM scored GROUP BY 2),
  grid AS (SELECT DISTINCT s.source, l.level FROM level_rows s, (SELECT unnest(range(1, 6)) AS level) l),
  cumulated AS (SELECT g.source, g.level, coalesce(sum(r.k), 0) * 100
      / (SELECT sum(k) FROM level_rows t WHERE t.source IS NOT DISTINCT FROM g.source) AS percentile
    FROM grid g LEFT JOIN level_rows r ON r.source IS NOT DISTINCT FROM g.source AND r.urgency_score <= g.level
    GROUP BY 1, 2)"""


@query("score_percentiles", over_corpus(
    "SELECT source, level, round(percentile, 6) AS percentile FROM cumulated", *V5_SQL, _LEVEL_ROWS))
def score_percentiles(spark, sf_dir):
    figures = U.score_percentiles(labelled(spark, sf_dir))
    return figures.select("source", "level", F.round("percentile", 6).alias("percentile"))


@query("posting_percentiles", over_corpus(
    """SELECT row_id, round(percentile, 6) AS percentile FROM scored s JOIN cumulated c
       ON c.level = s.urgency_score AND c.source IS NOT DISTINCT FROM CASE WHEN s.source <> 'wanted' THEN s.source END""",
    *V5_SQL, _LEVEL_ROWS))
def posting_percentiles(spark, sf_dir):
    """Percentile of each posting; wanted has no figures here and uses the total."""
    scored = cut_lineage(labelled(spark, sf_dir).select("row_id", "source", "urgency_score"))
    figures = U.score_percentiles(scored).where("source is null or source <> 'wanted'")
    return U.with_percentile(scored, figures).select(
        "row_id", F.round("percentile", 6).alias("percentile"))


@query("score_cautions", over_corpus(
    """SELECT row_id, CASE WHEN NOT measurable THEN 'unmeasurable'
       WHEN window_days IS NULL AND end_day IS NOT NULL THEN 'no_window'
       WHEN len(reasons) = 0 THEN 'no_signal' END AS caution FROM scored""", *V5_SQL))
def score_cautions(spark, sf_dir):
    return U.explanation_kind(labelled(spark, sf_dir), F.col("end").isNotNull()).select(
        "row_id", "caution")


@query("second_opinion", over_corpus(
    """SELECT row_id, old_label AS model_score, measurable AS in_scope, CASE WHEN NOT measurable THEN 'out_of_scope'
       WHEN old_label = urgency_score THEN 'agrees'
       ELSE 'differs_by_' || abs(old_label - urgency_score) END AS opinion FROM scored""", *V5_SQL))
def second_opinion(spark, sf_dir):
    return U.second_opinion(labelled(spark, sf_dir), F.col("old_label")).select(
        "row_id", "model_score", "in_scope", "opinion")
