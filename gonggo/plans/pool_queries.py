"""Freshness of the corpus on one day, and the pool of what can be recommended."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gonggo.operators import pool as P
from gonggo.operators import urgency_words as W
from gonggo.operators.techs import with_techs
from gonggo.plans.corpus import AS_OF, over_corpus, postings
from gonggo.plans.ingest_queries import MASTER_SQL, master
from gonggo.plans.registry import query
from gonggo.plans.tech_queries import FOUND_SQL, LISTED_SQL, skilled
from gonggo.plans.urgency_queries import V5_SQL, _always_open, _date, _has
from gonggo.session import cut_lineage


def _latest(column: str, pattern: str) -> str:
    return f"list_max(list_transform(regexp_extract_all({column}, '{pattern}', 0), lambda m: {_date('m', pattern, 1, 2, 3)}))"


DEADLINE_SQL = (
    f"""labelled AS (SELECT *, {_always_open('raw_text')} AS always, {_latest('raw_text', P.LABELLED_DATE)} AS label_date,
        regexp_extract(raw_text, '{W.PERIOD}', 1) AS raw_period, {_has('raw_text', W.ROLLING)} AS phrase FROM postings)""",
    f"""dates AS (SELECT *, CASE WHEN NOT always THEN {_latest('raw_period', P.ANY_DATE)} END AS period_date FROM labelled)""",
    f"""deadlines AS (SELECT *, coalesce(label_date, period_date) AS deadline,
        (CASE WHEN label_date IS NULL AND period_date IS NOT NULL THEN {_has('raw_period', W.ROLLING)} ELSE phrase END)
        OR always AS rolling FROM dates)""")
_STATUS = f"""CASE WHEN {{0}} >= DATE '{AS_OF}' THEN 'open' WHEN {{0}} < DATE '{AS_OF}' THEN 'closed'
    WHEN {{1}} THEN 'rolling' ELSE 'unknown' END"""


def backfill(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    """A side table for the saramin postings, one row per job_id."""
    rows = (postings(spark, sf_dir) if rows is None else rows).where("source = 'saramin'")
    first = rows.groupBy("job_id").agg(F.min(F.struct(
        "row_id", "title_text", "company_name", "place", "end", "qty", "n_lines")).alias("r"))
    r = F.col("r")
    status = F.when(r["n_lines"] == 1, "not_found").when(r["n_lines"] == 2, "parse_failed").otherwise("ok")
    ok = status == "ok"

    def given(c):
        return F.when(ok, c)
    return first.select(
        "job_id", given(r["title_text"]).alias("title"), given(r["company_name"]).alias("company"),
        given(F.lit("경력무관")).alias("experience_level"), given(F.lit("학력무관")).alias("education"),
        given(F.when(r["qty"] % 2 == 0, F.date_format(r["end"], "yyyy-MM-dd"))).alias("deadline"),
        given(F.when(r["n_lines"] > 3, r["place"])).alias("location"), status.alias("status"))


BACKFILL_SQL = """
firsts AS (SELECT job_id, arg_min(title_text, row_id) AS title_text, arg_min(company_name, row_id) AS company_name,
    arg_min(place, row_id) AS place, arg_min(end_day, row_id) AS end_day, arg_min(qty, row_id) AS qty,
    arg_min(n_lines, row_id) AS n_lines FROM postings WHERE source = 'saramin' GROUP BY job_id),
backfill AS (SELECT job_id, CASE WHEN n_lines > 2 THEN title_text END AS title,
    CASE WHEN n_lines > 2 THEN company_name END AS company, CASE WHEN n_lines > 2 THEN '경력무관' END AS experience_level,
    CASE WHEN n_lines > 2 THEN '학력무관' END AS education, CASE WHEN n_lines > 2 AND qty % 2 = 0 THEN end_day END AS deadline,
    CASE WHEN n_lines > 3 THEN place END AS location,
    CASE n_lines WHEN 1 THEN 'not_found' WHEN 2 THEN 'parse_failed' ELSE 'ok' END AS status FROM firsts)
"""
POOL_SQL = (*DEADLINE_SQL, FOUND_SQL, LISTED_SQL, BACKFILL_SQL, MASTER_SQL, f"""
pool AS (SELECT m.row_id, m.source, m.job_id, coalesce(m.title, b.title) AS title, coalesce(m.company, b.company) AS company,
    coalesce(m.location, b.location) AS location, coalesce(m.experience_level, b.experience_level) AS experience_level,
    s.techs, s.skills_extra, m.raw_text, coalesce(b.deadline, d.deadline) AS deadline,
    CASE WHEN b.deadline IS NOT NULL THEN false ELSE d.rolling END AS rolling,
    {_STATUS.format('coalesce(b.deadline, d.deadline)', 'CASE WHEN b.deadline IS NOT NULL THEN false ELSE d.rolling END')} AS status
  FROM master m JOIN deadlines d USING (row_id) JOIN skilled s USING (row_id)
  LEFT JOIN backfill b ON b.job_id = m.job_id AND m.source = 'saramin' AND b.status = 'ok'
  WHERE coalesce(m.title, b.title) IS NOT NULL AND coalesce(m.company, b.company) IS NOT NULL)""")


def recommendable(spark, sf_dir, **options) -> DataFrame:
    rows = cut_lineage(postings(spark, sf_dir))
    return P.recommendation_pool(with_techs(master(spark, sf_dir, rows)), AS_OF,
                                 backfill(spark, sf_dir, rows), **options)


@query("deadlines", over_corpus(
    f"SELECT row_id, deadline, rolling, {_STATUS.format('deadline', 'rolling')} AS status FROM deadlines", *DEADLINE_SQL))
def deadlines(spark, sf_dir):
    rows = P.with_deadline(postings(spark, sf_dir).select("row_id", "raw_text"))
    return rows.select("row_id", "deadline", "rolling", P.status_of(
        F.col("deadline"), F.col("rolling"), P.day(AS_OF)).alias("status"))


@query("recommendation_pool", over_corpus(
    """SELECT row_id, job_id, title, company, location, experience_level, array_to_string(techs, '|') AS techs,
       array_to_string(skills_extra, '|') AS skills_extra, deadline, rolling, status FROM pool""", *POOL_SQL))
def recommendation_pool(spark, sf_dir):
    return recommendable(spark, sf_dir).select(
        "row_id", "job_id", "title", "company", "location", "experience_level",
        F.concat_ws("|", "techs").alias("techs"), F.concat_ws("|", "skills_extra").alias("skills_extra"),
        "deadline", "rolling", "status")


@query("open_pool", over_corpus(
    """SELECT source, status, count(*) AS n FROM pool WHERE status IN ('open', 'rolling') AND len(techs) > 0
       AND source IN ('jobkorea', 'saramin') GROUP BY 1, 2""", *POOL_SQL))
def open_pool(spark, sf_dir):
    rows = recommendable(spark, sf_dir, only_open=True, require_techs=True,
                         sources=["jobkorea", "saramin"])
    return rows.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


_COUNTS = """count(*) AS n, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'closed') AS closed,
    count(*) FILTER (status = 'rolling') AS rolling, count(*) FILTER (status = 'unknown') AS unknown,
    count(*) FILTER (len(techs) = 0) AS no_techs, count(*) FILTER (len(techs) = 0 AND len(skills_extra) = 0) AS no_skills,
    count(*) FILTER (location IS NULL) AS no_location, count(*) FILTER (experience_level IS NULL) AS no_level FROM pool"""


@query("pool_report", over_corpus(
    f"SELECT source, {_COUNTS} GROUP BY source UNION ALL SELECT NULL, {_COUNTS}", *POOL_SQL))
def pool_report(spark, sf_dir):
    return P.pool_report(recommendable(spark, sf_dir))


@query("duplicate_keys", over_corpus(
    """SELECT count(*) AS duplicate_keys, coalesce(sum(c), 0) AS rows_in_them, coalesce(sum(c - 1), 0) AS repeats
       FROM (SELECT count(*) AS c FROM postings GROUP BY source, job_id HAVING count(*) > 1)"""),
       BIGINT=("rows_in_them", "repeats"))
def duplicate_keys(spark, sf_dir):
    return P.duplicate_keys(postings(spark, sf_dir))


_SHAPED = f"""shaped AS (SELECT row_id, source, window_end AS end_date, rolling,
    window_days IS NULL AND is_always_open AS always_open,
    CASE WHEN a_days IS NOT NULL THEN '{P.SHAPE_A}' WHEN window_days IS NOT NULL THEN '{P.SHAPE_B}'
         WHEN has_period AND is_always_open THEN '{P.SHAPE_B_OPEN}' WHEN has_period THEN '{P.SHAPE_B_FAILED}'
         WHEN is_always_open THEN '{P.SHAPE_OPEN_ONLY}' ELSE '{P.SHAPE_NONE}' END AS shape,
    CASE WHEN window_days IS NULL AND is_always_open THEN '{P.ALIVE_OPEN}' WHEN window_end IS NULL THEN '{P.UNDECIDED}'
         WHEN window_end >= DATE '{AS_OF}' THEN '{P.ALIVE_DATED}' ELSE '{P.GONE}' END AS alive_class FROM signals)"""
_ALIVE = f"""count(*) AS n, count(*) FILTER (alive_class = '{P.ALIVE_DATED}') AS alive_dated,
    count(*) FILTER (alive_class = '{P.ALIVE_OPEN}') AS alive_open, count(*) FILTER (alive_class = '{P.GONE}') AS gone,
    count(*) FILTER (alive_class = '{P.UNDECIDED}') AS undecided,
    count(*) FILTER (rolling AND end_date >= DATE '{AS_OF}') AS rolling_but_dated,
    round(count(*) FILTER (alive_class IN ('{P.ALIVE_DATED}', '{P.ALIVE_OPEN}')) * 100 / count(*), 1) AS alive_pct FROM shaped"""


@query("alive_ratio", over_corpus(
    f"SELECT source, {_ALIVE} GROUP BY source UNION ALL SELECT NULL, {_ALIVE}", *V5_SQL[:6], _SHAPED))
def alive_ratio(spark, sf_dir):
    return P.alive_ratio(P.deadline_shape(postings(spark, sf_dir), AS_OF))


@query("deadline_shapes", over_corpus(
    "SELECT shape, count(*) AS n FROM shaped GROUP BY shape", *V5_SQL[:6], _SHAPED))
def deadline_shapes(spark, sf_dir):
    return P.shape_counts(P.deadline_shape(postings(spark, sf_dir), AS_OF))


IDF_SQL = """idf AS (SELECT tech, df, CAST(ln((SELECT count(*) FROM postings) / df) AS DECIMAL(18, 12)) AS idf FROM (
    SELECT tech, count(*) AS df FROM (SELECT unnest(techs) AS tech FROM skilled) GROUP BY tech HAVING count(*) >= 5))"""


@query("tech_idf", over_corpus(
    "SELECT tech, df, round(CAST(idf AS DOUBLE), 9) AS idf FROM idf", FOUND_SQL, LISTED_SQL, IDF_SQL))
def tech_idf(spark, sf_dir):
    return P.tech_idf(skilled(spark, sf_dir)).select(
        "tech", "df", F.round(F.col("idf").cast("double"), 9).alias("idf"))


@query("skill_idf", over_corpus(
    """SELECT tech, count(*) AS df, round(ln((SELECT count(*) FROM postings) / count(*)), 9) AS idf FROM (
       SELECT unnest(list_distinct(list_concat(techs, skills_extra))) AS tech FROM skilled)
       GROUP BY tech HAVING count(*) >= 5""", FOUND_SQL, LISTED_SQL))
def skill_idf(spark, sf_dir):
    """The same weights with skills outside the dictionary."""
    return P.tech_idf(skilled(spark, sf_dir), include_extra=True).select(
        "tech", "df", F.round(F.col("idf").cast("double"), 9).alias("idf"))


@query("pool_guards", over_corpus(
    f"""SELECT 'with backfill' AS pool, count(*) AS rows_seen, count(*) FILTER ((m.title IS NULL AND b.title IS NOT NULL)
        OR (m.company IS NULL AND b.company IS NOT NULL)) AS merged, count(*) FILTER (coalesce(m.title, b.title) IS NULL
        OR coalesce(m.company, b.company) IS NULL) AS unnamed, CAST(NULL AS VARCHAR) AS warning FROM master m
        LEFT JOIN backfill b ON b.job_id = m.job_id AND m.source = 'saramin' AND b.status = 'ok'
        UNION ALL SELECT 'without', count(*), 0, count(*) FILTER (title IS NULL OR company IS NULL), '{P.NO_BACKFILL}' FROM master""",
    BACKFILL_SQL, MASTER_SQL), BIGINT=("rows_seen", "merged", "unnamed"))
def pool_guards(spark, sf_dir):
    """What the pool's own pass observes, with and without the side table."""
    rows = cut_lineage(postings(spark, sf_dir))
    plain = cut_lineage(with_techs(master(spark, sf_dir, rows), text=None))
    found = [(name, P.guarded_pool(plain, AS_OF, side)[1]) for name, side in (
        ("with backfill", backfill(spark, sf_dir, rows)), ("without", None))]
    return spark.createDataFrame([(n, f["rows"], f["merged"], f["unnamed"], f["warning"]) for n, f in found],
                                 "pool string, rows_seen long, merged long, unnamed long, warning string")
