"""Matching résumés to the pool, and the label-free check of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gonggo.operators import matching as M
from gonggo.operators import pool as P
from gonggo.operators import proxy as X
from gonggo.operators.techs import expand_hypernyms, extract_techs, with_techs
from gonggo.plans.corpus import AS_OF, BRAND_TECHS, over_corpus, postings, read
from gonggo.plans.ingest_queries import master
from gonggo.plans.pool_queries import IDF_SQL, POOL_SQL, backfill, recommendable
from gonggo.plans.registry import query
from gonggo.plans.tech_queries import skilled
from gonggo.session import cut_lineage

# a résumé per nation: three brand numbers computed from its key
_STEPS = ((1, 0), (7, 3), (3, 5))
_SPELLINGS = "[" + ", ".join(f"'{s}'" for _, s in BRAND_TECHS) + "]"
_TECHS = "[" + ", ".join(f"'{t}'" for t, _ in BRAND_TECHS) + "]"
LEVELS = ("신입", "1~3년차", "3~5년차", "5년이상", "경력무관")


def resumes(spark, sf_dir) -> DataFrame:
    """query_id, resume_text, want_location, want_experience_level."""
    spelled = F.array(*(F.lit(s) for _, s in BRAND_TECHS))
    levels = F.array(*(F.lit(v) for v in LEVELS))
    words = [spelled[(F.col("n_nationkey") * a + b) % 25] for a, b in _STEPS]
    return read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("query_id"),
        F.concat(F.lit("저는 "), F.concat_ws(", ", *words), F.lit(" 경험과 엑셀 활용 능력이 있습니다"))
        .alias("resume_text"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("want_location"),
        levels[F.col("n_regionkey")].alias("want_experience_level"))


RESUME_SQL = f"""
resumes AS (SELECT n_nationkey AS query_id, list_sort(list_distinct(list_filter(
      [{", ".join(f"({_TECHS})[(n_nationkey * {a} + {b}) % 25 + 1]" for a, b in _STEPS)}],
      lambda t: t <> '시스템'))) AS techs,
    '저는 ' || array_to_string([{", ".join(f"({_SPELLINGS})[(n_nationkey * {a} + {b}) % 25 + 1]" for a, b in _STEPS)}], ', ')
      || ' 경험과 엑셀 활용 능력이 있습니다' AS resume_text,
    CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS want_location,
    ({list(LEVELS)!r})[n_regionkey + 1] AS want_experience_level FROM nation)
"""


def asked(spark, sf_dir) -> DataFrame:
    return resumes(spark, sf_dir).withColumn("techs", extract_techs(F.col("resume_text")))


def corpus_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The corpus with its skills, written once, and the side table: pool and weights are taken from these."""
    rows = cut_lineage(postings(spark, sf_dir))
    return cut_lineage(with_techs(master(spark, sf_dir, rows))), backfill(spark, sf_dir, rows)


def pool_and_weights(spark, sf_dir, **options) -> tuple[DataFrame, DataFrame]:
    rows, side = corpus_rows(spark, sf_dir)
    return P.recommendation_pool(rows, AS_OF, side, **options), P.tech_idf(rows)


# sums over shared skills and over each side; `side` tables hold (id, techs)
def match_sql(queries: str, jobs: str, job_id: str, condition: str = "true") -> tuple[str, ...]:
    zero = "CAST(0 AS DECIMAL(18, 12))"
    def sums(name, table, key):
        return f"""{name}_t AS (SELECT {key}, t.tech, coalesce(idf.idf, {zero}) AS w
            FROM (SELECT {key}, unnest(techs) AS tech FROM {table}) t LEFT JOIN idf ON idf.tech = t.tech),
          {name}_s AS (SELECT {key}, sum(w) AS {name}, sum(CAST(w * w AS DECIMAL(38, 24))) AS {name}_sq,
            count(*) AS {name}_n FROM {name}_t GROUP BY ALL)"""
    return (sums("mine", queries, "query_id"), sums("job", jobs, "row_id"),
            f"""hits AS (SELECT query_id, row_id, sum(j.w) AS hit, sum(CAST(j.w * j.w AS DECIMAL(38, 24))) AS hit_sq,
                count(*) AS hit_n, list_sort(list(j.tech)) AS matched FROM mine_t m JOIN job_t j ON j.tech = m.tech GROUP BY ALL)""",
            f"""sides AS (SELECT h.*, p.{job_id} AS entity, mine, mine_sq, mine_n, job, job_sq, job_n FROM hits h
                JOIN mine_s USING (query_id) JOIN job_s USING (row_id) JOIN {jobs} p USING (row_id)
                JOIN {queries} q USING (query_id) WHERE {condition})""")


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _one(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} ELSE 1.0 END"


SCORE_SQL = {
    "raw_idf": _d("hit"),
    "length_norm": f"{_d('hit')} / {_one('sqrt(' + _d('job') + ')')}",
    "jaccard": f"{_d('hit_n')} / (mine_n + job_n - hit_n)",
    "cosine": f"{_d('hit_sq')} / (({_one('sqrt(' + _d('mine_sq') + ')')}) * ({_one('sqrt(' + _d('job_sq') + ')')}))",
    "per_skill_count": f"{_d('hit')} / job_n",
}
SCHEME_SQL = {
    "none": SCORE_SQL["raw_idf"], "sqrt": SCORE_SQL["length_norm"],
    "linear": f"{_d('hit')} / {_one(_d('job'))}", "count": SCORE_SQL["per_skill_count"],
    "cosine": SCORE_SQL["cosine"],
    "jaccard": f"CASE WHEN job + mine - hit > 0 THEN {_d('hit')} / {_d('(job + mine - hit)')} ELSE 0.0 END",
}


def best_sql(score: str, k: int = 10) -> str:
    """Best score per (query, entity), then the k best."""
    return f"""SELECT query_id, r AS rank, entity, round(score, 9) AS score, matched FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS r FROM (
          SELECT query_id, entity, max(score) AS score, arg_min(matched, row_id) FILTER (score = top) AS matched FROM (
            SELECT query_id, entity, row_id, matched, score, max(score) OVER (PARTITION BY query_id, entity) AS top
            FROM (SELECT query_id, entity, row_id, matched, round({score}, 12) AS score FROM sides))
          GROUP BY query_id, entity)) WHERE r <= {k}"""


def shown(best: DataFrame, *more: str) -> DataFrame:
    return best.select("query_id", "rank", "job_id", F.round("score", 9).alias("score"),
                       F.concat_ws("|", "matched_techs").alias("matched_techs"), *more)


_SHOWN = "SELECT query_id, rank, entity AS job_id, score, array_to_string(matched, '|') AS matched_techs FROM ({})"

for _mode in M.SCORERS:
    @query(f"recommend_{_mode}", over_corpus(_SHOWN.format(best_sql(SCORE_SQL[_mode])), *POOL_SQL, IDF_SQL, RESUME_SQL,
                                             *match_sql("resumes", "pool", "job_id")))
    def recommend(spark, sf_dir, mode=_mode):
        return shown(M.top_matches(asked(spark, sf_dir), *pool_and_weights(spark, sf_dir), 10, mode))


_PASS = " AND ".join(f"(q.want_{f} IS NULL OR p.{f} IS NULL OR q.want_{f} = p.{f})" for f in M.FILTERS)


@query("recommend_filtered", over_corpus(
    _SHOWN.format(best_sql(SCORE_SQL["length_norm"])), *POOL_SQL, IDF_SQL, RESUME_SQL,
    *match_sql("resumes", "pool", "job_id", _PASS)))
def recommend_filtered(spark, sf_dir):
    """Hard filters on level and place; a value missing on either side passes."""
    return shown(M.top_matches(asked(spark, sf_dir), *pool_and_weights(spark, sf_dir), 10, filters=M.FILTERS))


@query("recommend_open_only", over_corpus(
    _SHOWN.format(best_sql(SCORE_SQL["length_norm"], 5)), *POOL_SQL, IDF_SQL, RESUME_SQL,
    "live AS (SELECT * FROM pool WHERE status IN ('open', 'rolling'))", *match_sql("resumes", "live", "job_id")))
def recommend_open_only(spark, sf_dir):
    return shown(M.top_matches(asked(spark, sf_dir), *pool_and_weights(spark, sf_dir, only_open=True), 5))


@query("recommend_hypernyms", over_corpus(
    _SHOWN.format(best_sql(SCORE_SQL["length_norm"])), *POOL_SQL, IDF_SQL, RESUME_SQL,
    """wider AS (SELECT * REPLACE (list_distinct(list_concat(techs, CASE WHEN list_contains(techs, 'Spring Boot')
       THEN ['Spring'] ELSE [] END)) AS techs) FROM resumes)""", *match_sql("wider", "pool", "job_id")))
def recommend_hypernyms(spark, sf_dir):
    wider = asked(spark, sf_dir).withColumn("techs", expand_hypernyms(F.col("techs")))
    return shown(M.top_matches(wider, *pool_and_weights(spark, sf_dir)))


RELATED_SHARE = 0.4
_RELATED = f"""held AS (SELECT row_id, unnest(techs) AS tech FROM skilled),
  together AS (SELECT a.tech AS base, b.tech, count(*) AS n FROM held a JOIN held b USING (row_id)
    WHERE a.tech <> b.tech AND a.tech IN (SELECT tech FROM idf) AND b.tech IN (SELECT tech FROM idf) GROUP BY 1, 2),
  alone AS (SELECT tech AS base, count(*) AS match_count FROM held GROUP BY 1),
  related AS (SELECT base, list(tech ORDER BY r) AS related FROM (SELECT base, tech,
    row_number() OVER (PARTITION BY base ORDER BY n DESC, tech) AS r FROM together JOIN alone USING (base)
    WHERE n >= match_count * {RELATED_SHARE}) WHERE r <= 2 GROUP BY base)"""


def related(spark, sf_dir) -> DataFrame:
    rows = cut_lineage(skilled(spark, sf_dir).select("row_id", "techs"))
    return M.build_related_map(rows.where(F.size("techs") > 0), P.tech_idf(rows), RELATED_SHARE)


@query("related_expansion", over_corpus(
    """SELECT query_id, array_to_string(list_sort(list_distinct(list_concat(any_value(techs),
       coalesce(flatten(list(related)), [])))), '|') AS techs FROM (SELECT query_id, techs, unnest(techs) AS base FROM resumes)
       LEFT JOIN related USING (base) GROUP BY query_id""", *POOL_SQL, IDF_SQL, RESUME_SQL, _RELATED))
def related_expansion(spark, sf_dir):
    """Résumé skills with the ones that usually come with them."""
    out = M.expand_related(asked(spark, sf_dir), related(spark, sf_dir))
    return out.select("query_id", F.concat_ws("|", "techs").alias("techs"))


@query("extra_skills", over_corpus(
    """SELECT query_id, array_to_string(list_sort(list(skill)), '|') AS skills FROM resumes, (
       SELECT skill FROM (SELECT unnest(skills_extra) AS skill FROM skilled) GROUP BY skill HAVING count(*) >= 5)
       WHERE contains(lower(resume_text), skill) GROUP BY query_id""", *POOL_SQL[3:5], RESUME_SQL))
def extra_skills(spark, sf_dir):
    """Skills outside the dictionary that résumés mention."""
    found = M.extras_in_text(resumes(spark, sf_dir), M.extra_vocabulary(skilled(spark, sf_dir)))
    return found.select("query_id", F.concat_ws("|", "techs").alias("skills"))


@query("recommend_with_extras", over_corpus(
    _SHOWN.format(best_sql(SCORE_SQL["length_norm"])), *POOL_SQL,
    IDF_SQL, RESUME_SQL,
    """vocabulary AS (SELECT skill FROM (SELECT unnest(skills_extra) AS skill FROM skilled) GROUP BY skill HAVING count(*) >= 5),
    wider AS (SELECT query_id, list_distinct(list_concat(any_value(techs), coalesce(list(skill) FILTER (skill IS NOT NULL), []))) AS techs
      FROM resumes LEFT JOIN vocabulary ON contains(lower(resume_text), skill) GROUP BY query_id),
    wide_pool AS (SELECT * REPLACE (list_distinct(list_concat(techs, skills_extra)) AS techs) FROM pool)""",
    *match_sql("wider", "wide_pool", "job_id")))
def recommend_with_extras(spark, sf_dir):
    rows, side = corpus_rows(spark, sf_dir)
    found = M.extras_in_text(resumes(spark, sf_dir), M.extra_vocabulary(rows)) \
        .withColumnRenamed("techs", "extra")
    mine = asked(spark, sf_dir).join(found, "query_id", "left").withColumn(
        "techs", F.array_union("techs", F.coalesce("extra", F.array().cast("array<string>"))))
    pool = P.recommendation_pool(rows, AS_OF, side).withColumn("techs", F.array_union("techs", "skills_extra"))
    return shown(M.top_matches(mine, pool, P.tech_idf(rows)))


# Every fifth résumé names no skill at all.
_PLAIN = "저는 새로운 업무 안내 온라인 모집인원 "


def mixed_resumes(spark, sf_dir) -> DataFrame:
    plain = F.concat(F.lit(_PLAIN), F.lower("want_place"), F.lit(" 개발자"))
    named = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("want_place"))
    return resumes(spark, sf_dir).join(F.broadcast(named), "query_id").withColumn(
        "resume_text", F.when(F.col("query_id") % 5 == 4, plain).otherwise(F.col("resume_text"))).drop("want_place")


_WORDS = "list_distinct(list_filter(list_transform(regexp_extract_all({}, '[A-Za-z가-힣0-9]+'), lambda w: lower(w)), lambda w: length(w) >= 2))"


@query("recommend", over_corpus(
    _SHOWN.format(best_sql(SCORE_SQL["length_norm"])).replace("AS matched_techs", "AS matched_techs, CAST(NULL AS VARCHAR) AS fallback")
    + """ UNION ALL SELECT query_id, r, job_id, round(score, 9), '', 'text_overlap' FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, job_id) AS r FROM (
        SELECT query_id, job_id, max(score) AS score FROM likeness GROUP BY ALL)) WHERE r <= 10""",
    *POOL_SQL, IDF_SQL, RESUME_SQL.replace("resumes AS", "skilful AS"), _RELATED,
    f"""resumes AS (SELECT s.* REPLACE (CASE WHEN query_id % 5 = 4 THEN [] ELSE techs END AS techs,
        CASE WHEN query_id % 5 = 4 THEN '{_PLAIN}' || lower(n_name) || ' 개발자' ELSE resume_text END AS resume_text)
      FROM skilful s JOIN nation ON n_nationkey = query_id),
    general AS (SELECT * REPLACE (list_concat(techs, CASE WHEN list_contains(techs, 'Spring Boot') THEN ['Spring'] ELSE [] END) AS techs) FROM resumes),
    companions AS (SELECT query_id, unnest(related) AS tech FROM (SELECT query_id, unnest(techs) AS base FROM general) JOIN related USING (base)),
    vocabulary AS (SELECT skill FROM (SELECT unnest(skills_extra) AS skill FROM skilled) GROUP BY skill HAVING count(*) >= 5),
    mentioned AS (SELECT query_id, skill AS tech FROM resumes, vocabulary WHERE contains(lower(resume_text), skill)),
    added AS (SELECT query_id, list(tech) AS more FROM (SELECT * FROM companions UNION ALL SELECT * FROM mentioned) GROUP BY query_id),
    wider AS (SELECT g.* REPLACE (list_distinct(list_concat(techs, coalesce(more, []))) AS techs) FROM general g LEFT JOIN added USING (query_id)),
    wide_pool AS (SELECT * REPLACE (list_distinct(list_concat(techs, skills_extra)) AS techs) FROM pool),
    mine_w AS (SELECT *, {_WORDS.format('resume_text')} AS words FROM wider WHERE len(techs) = 0),
    job_w AS (SELECT *, {_WORDS.format('raw_text')} AS words FROM pool),
    likeness AS (SELECT query_id, job_id, round(len(list_intersect(q.words, p.words))
        / (len(q.words) + len(p.words) - len(list_intersect(q.words, p.words))), 12) AS score
      FROM mine_w q JOIN job_w p ON {_PASS} AND len(list_intersect(q.words, p.words)) > 0)""",
    *match_sql("wider", "wide_pool", "job_id", _PASS)))
def recommend_resumes(spark, sf_dir):
    """The matcher's one entry, with its filters and all its flags; résumés without skills go by their words."""
    rows, side = corpus_rows(spark, sf_dir)
    best = M.recommend(mixed_resumes(spark, sf_dir), rows, AS_OF, 10, M.FILTERS,
                       M.Flags(True, True, True, True, RELATED_SHARE), backfill=side)
    return shown(best, "fallback")


@query("text_fallback", """
    WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(list_transform(
           regexp_extract_all(text, '[A-Za-z가-힣0-9]+'), lambda w: lower(w)), lambda w: length(w) >= 2)) AS words FROM benchmark),
      d AS (SELECT doc_id, list_distinct(list_filter(list_transform(
           regexp_extract_all(text, '[A-Za-z가-힣0-9]+'), lambda w: lower(w)), lambda w: length(w) >= 2)) AS words FROM documents),
      qt AS (SELECT query_id, len(words) AS qn, unnest(words) AS w FROM q),
      dt AS (SELECT doc_id, len(words) AS dn, unnest(words) AS w FROM d),
      scored AS (SELECT query_id, doc_id, round(count(*) / (any_value(qn) + any_value(dn) - count(*)), 12) AS score
        FROM qt JOIN dt USING (w) GROUP BY 1, 2)
    SELECT query_id, r AS rank, job_id, round(score, 9) AS score FROM (SELECT query_id, CAST(doc_id AS VARCHAR) AS job_id, score,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS r FROM scored) WHERE r <= 10""")
def text_fallback(spark, sf_dir):
    """Documents by word overlap with the benchmark texts, whole texts on both sides."""
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"),
                                                      F.col("text").alias("resume_text"))
    pool = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("job_id"),
                                                   F.col("text").alias("raw_text"))
    return M.text_matches(queries, pool).select("query_id", "rank", "job_id",
                                                F.round("score", 9).alias("score"))


# ---------------------------------------------------------------- the check without labels

def _hash(*parts: str) -> str:
    return "CAST(('0x' || left(md5(" + " || '|' || ".join(parts) + "), 15)) AS BIGINT)"


def _proxy_sql(ratios=X.RATIOS) -> str:
    picks = " UNION ALL ".join(f"SELECT CAST({r} AS DOUBLE) AS ratio" for r in ratios)
    return f"""
chosen AS (SELECT row_id, job_id, techs FROM pool WHERE len(techs) >= 3 AND job_id IN (
    SELECT job_id FROM pool GROUP BY job_id HAVING count(*) = 1)
  ORDER BY {_hash("'0'", 'row_id')}, row_id LIMIT {X.QUERIES}),
asked AS (SELECT row_id AS target_row, job_id AS target, ratio, row_id || '/' || ratio AS query_id,
    list_sort(list_transform(list_slice(list_sort(list_transform(techs, lambda t: [md5('0|' || row_id || '|' || t), t])), 1,
      greatest(1, CAST(round_even(len(techs) * ratio, 0) AS INTEGER))), lambda x: x[2])) AS techs
  FROM chosen, ({picks}))
"""


def proxy_inputs(spark, sf_dir):
    """(pool, idf, queries); the pool is read several times, so it is written once."""
    pool, idf = pool_and_weights(spark, sf_dir)
    pool = cut_lineage(pool.select("row_id", "job_id", "techs", "skills_extra", "location", "experience_level"))
    return pool, idf, cut_lineage(X.make_query_set(pool))


@query("pseudo_resumes", over_corpus(
    "SELECT target_row AS query_id, target, ratio, array_to_string(techs, '|') AS techs FROM asked",
    *POOL_SQL, _proxy_sql()))
def pseudo_resumes(spark, sf_dir):
    pool = recommendable(spark, sf_dir).select("row_id", "job_id", "techs")
    return X.make_query_set(pool).select("query_id", "target", "ratio",
                                                  F.concat_ws("|", "techs").alias("techs"))


def _scheme_rows(registry: dict, entity: str) -> str:
    def one(name, score):
        inner = best_sql(score)
        # baseline: rows, ties by row; product: job ids, each once
        key = "target_row" if entity == "row_id" else "target"
        return f"""SELECT '{name}' AS scheme, ratio, count(*) AS n, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 9) AS recall,
            round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 / rank END), 9) AS mrr
            FROM asked LEFT JOIN ({inner}) b ON b.query_id = asked.query_id AND b.entity = asked.{key} GROUP BY ratio"""
    return " UNION ALL ".join(one(n, s) for n, s in registry.items())


def _figures(df: DataFrame) -> DataFrame:
    return df.select("scheme", "ratio", "n", F.round("recall", 9).alias("recall"),
                     F.round("mrr", 9).alias("mrr"))


@query("compare_schemes", over_corpus(_scheme_rows(SCHEME_SQL, "row_id"), *POOL_SQL, IDF_SQL, _proxy_sql(),
                                      *match_sql("asked", "pool", "row_id")))
def compare_schemes(spark, sf_dir):
    """Recall@10 and mean reciprocal rank of the six baseline schemes."""
    pool, idf, queries = proxy_inputs(spark, sf_dir)
    return _figures(X.compare(pool, idf, queries))


@query("compare_score_modes", over_corpus(_scheme_rows(SCORE_SQL, "job_id"), *POOL_SQL, IDF_SQL, _proxy_sql(),
                                          *match_sql("asked", "pool", "job_id")))
def compare_score_modes(spark, sf_dir):
    """The same figures for the five modes of the matcher itself."""
    pool, idf, queries = proxy_inputs(spark, sf_dir)
    return _figures(X.compare(pool, idf, queries, product=True))


@query("random_expected", over_corpus(
    """SELECT count(*) AS pool_size, round(least(1.0, 10 / count(*)), 12) AS recall,
       round((1 + 1/2 + 1/3 + 1/4 + 1/5 + 1/6 + 1/7 + 1/8 + 1/9 + 1/10) / count(*), 12) AS mrr FROM pool""", *POOL_SQL))
def random_expected(spark, sf_dir):
    out = X.random_expected(recommendable(spark, sf_dir))
    return out.select("pool_size", F.round("recall", 12).alias("recall"), F.round("mrr", 12).alias("mrr"))


@query("random_baseline", over_corpus(
    f"""SELECT ratio, count(*) AS n, avg(CASE WHEN place <= 10 THEN 1.0 ELSE 0.0 END) AS recall,
        round(avg(CASE WHEN place <= 10 THEN 1.0 / place ELSE 0.0 END), 9) AS mrr FROM (
        SELECT ratio, {_hash("'0'", 'target_row', 'CAST(ratio AS VARCHAR)')} % (SELECT count(*) FROM pool) + 1 AS place FROM asked)
        GROUP BY ratio""", *POOL_SQL, _proxy_sql()))
def random_baseline(spark, sf_dir):
    pool = recommendable(spark, sf_dir).select("row_id", "job_id", "techs")
    return X.random_baseline(pool, X.make_query_set(pool)).select(
        "ratio", "n", "recall", F.round("mrr", 9).alias("mrr"))
