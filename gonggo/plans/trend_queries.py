"""Dashboard statistics over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from gonggo.operators import trends as D
from gonggo.plans.corpus import over_corpus, postings, read
from gonggo.plans.ingest_queries import MASTER_SQL, master
from gonggo.plans.registry import query
from gonggo.plans.tech_queries import _STOP

_MENTIONS = "mentions AS (SELECT row_id, source, unnest(final_techs) AS tech FROM postings)"
_SETS = f"""sets AS (SELECT row_id, source, list_sort(list_filter(list_distinct(final_techs),
    lambda t: NOT list_contains({_STOP}, t))) AS techs FROM postings)"""
_UNIVERSE = """members AS (SELECT row_id, unnest(techs) AS tech FROM sets),
  universe AS (SELECT tech FROM members GROUP BY tech ORDER BY count(*) DESC, tech LIMIT 50)"""
_PAIRS = """pairs AS (SELECT a.tech AS base, b.tech, count(*) AS n FROM members a JOIN members b USING (row_id)
    WHERE a.tech <> b.tech AND a.tech IN (FROM universe) AND b.tech IN (FROM universe) GROUP BY 1, 2),
  matched AS (SELECT tech AS base, count(*) AS match_count FROM members GROUP BY 1)"""


@query("tech_frequency", over_corpus(
    "SELECT tech, count(*) AS n FROM mentions GROUP BY tech", _MENTIONS))
def tech_frequency(spark, sf_dir):
    return D.tech_frequency(postings(spark, sf_dir))


@query("top_techs", over_corpus(
    """SELECT tech, count(*) AS n FROM mentions WHERE source IN ('jobkorea', 'wanted')
       GROUP BY tech ORDER BY n DESC, tech LIMIT 20""", _MENTIONS))
def top_techs(spark, sf_dir):
    rows = D.of_sources(postings(spark, sf_dir), ["jobkorea", "wanted"])
    return D.top_techs(D.tech_frequency(rows), 20)


@query("headline_figures", over_corpus(
    """SELECT count(DISTINCT row_id) AS postings, (SELECT count(DISTINCT tech) FROM mentions) AS distinct_techs,
       count(DISTINCT source) AS sources FROM postings""", _MENTIONS))
def headline_figures(spark, sf_dir):
    return D.headline_figures(postings(spark, sf_dir))


@query("document_frequency", over_corpus(
    "SELECT tech, count(*) AS n FROM (SELECT unnest(techs) AS tech FROM sets) GROUP BY tech", _SETS))
def document_frequency(spark, sf_dir):
    return D.document_frequency(D.posting_sets(postings(spark, sf_dir)))


@query("related_techs", over_corpus(
    """SELECT tech, n, match_count, round(n * 100 / match_count, 1) AS rate_pct
       FROM pairs JOIN matched USING (base) WHERE base = 'Python'""", _SETS, _UNIVERSE, _PAIRS))
def related_techs(spark, sf_dir):
    """Flagship: what is required together with Python, and how often."""
    sets = D.posting_sets(postings(spark, sf_dir))
    return D.related_techs(sets, "Python", D.universe_of(sets))


@query("companions", over_corpus(
    """SELECT count(*) AS related_techs, max(match_count) AS match_count,
       round(sum(n) / max(match_count), 6) AS mean_companions
       FROM pairs JOIN matched USING (base) WHERE base = 'Docker'""", _SETS, _UNIVERSE, _PAIRS))
def companions(spark, sf_dir):
    sets = D.posting_sets(postings(spark, sf_dir))
    out = D.companions(D.related_techs(sets, "Docker", D.universe_of(sets)))
    return out.withColumn("mean_companions", F.round("mean_companions", 6))


@query("cooccurrence", over_corpus(
    "SELECT base, tech, n, match_count FROM pairs JOIN matched USING (base)", _SETS, _UNIVERSE, _PAIRS))
def cooccurrence(spark, sf_dir):
    sets = D.posting_sets(postings(spark, sf_dir))
    return D.cooccurrence(sets, D.universe_of(sets))


@query("related_map", over_corpus(
    """SELECT base, array_to_string(list(tech ORDER BY r), '|') AS related FROM (
       SELECT base, tech, row_number() OVER (PARTITION BY base ORDER BY n DESC, tech) AS r
       FROM pairs JOIN matched USING (base) WHERE n >= match_count * 0.1) WHERE r <= 2 GROUP BY base""",
    _SETS, _UNIVERSE, _PAIRS))
def related_map(spark, sf_dir):
    sets = D.posting_sets(postings(spark, sf_dir))
    out = D.related_map(D.cooccurrence(sets, D.universe_of(sets)), min_ratio=0.1)
    return out.select("base", F.concat_ws("|", "related").alias("related"))


@query("brand_cooccurrence",
       """WITH held AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
          SELECT a.p_brand AS base, b.p_brand AS tech, count(*) AS n,
            (SELECT count(*) FROM held h WHERE h.p_brand = a.p_brand) AS match_count
          FROM held a JOIN held b USING (l_orderkey) WHERE a.p_brand <> b.p_brand GROUP BY 1, 2""")
def brand_cooccurrence(spark, sf_dir):
    """The same counts on the plain tables: brands ordered together."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    sets = (read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey")
            .groupBy("l_orderkey").agg(F.sort_array(F.collect_set("p_brand")).alias("techs")))
    return D.cooccurrence(sets, D.universe_of(sets))


# ---------------------------------------------------------------- regions

_MAPPED = """mapped AS (SELECT p.*, n_nationkey * 1.5 AS lat, n_regionkey * 10.25 AS lon
    FROM postings p JOIN nation ON n_name = location)"""


def mapped(spark, sf_dir):
    coords = read(spark, sf_dir, "nation").select(
        F.col("n_name").alias("location"), (F.col("n_nationkey") * 1.5).alias("lat"),
        (F.col("n_regionkey") * 10.25).alias("lon"))
    return D.on_map(postings(spark, sf_dir), coords)


@query("region_summary", over_corpus(
    """SELECT location, max(lat) AS lat, max(lon) AS lon, count(*) AS job_count,
       sum(len(final_techs)) AS tech_mentions FROM mapped GROUP BY location""", _MAPPED),
       DOUBLE=("lat", "lon"), BIGINT=("tech_mentions",))
def region_summary(spark, sf_dir):
    return D.region_summary(mapped(spark, sf_dir))


@query("busiest_region", over_corpus(
    """SELECT location, job_count FROM (SELECT location, count(*) AS job_count FROM mapped GROUP BY 1)
       ORDER BY job_count DESC, location LIMIT 1""", _MAPPED))
def busiest_region(spark, sf_dir):
    return D.busiest_region(D.region_summary(mapped(spark, sf_dir))).select("location", "job_count")


@query("region_top_techs", over_corpus(
    """SELECT location, tech, n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY n DESC, tech) AS r
       FROM (SELECT location, tech, count(*) AS n FROM (SELECT location, unnest(final_techs) AS tech FROM mapped)
             GROUP BY 1, 2 HAVING count(*) >= 2)) WHERE r <= 10""", _MAPPED))
def region_top_techs(spark, sf_dir):
    return D.region_top_techs(mapped(spark, sf_dir))


@query("nation_top_techs", over_corpus(
    """SELECT tech, count(*) AS n FROM (SELECT unnest(final_techs) AS tech FROM mapped)
       GROUP BY tech HAVING count(*) >= 3 ORDER BY n DESC, tech LIMIT 10""", _MAPPED))
def nation_top_techs(spark, sf_dir):
    return D.nation_top_techs(mapped(spark, sf_dir))


# ---------------------------------------------------------------- experience levels

def levelled(spark, sf_dir):
    """The merged table with a score (the stand-in label) beside the level."""
    labels = postings(spark, sf_dir).select("row_id", F.col("old_label").alias("urgency_score"))
    return master(spark, sf_dir).drop("urgency_score").join(labels, "row_id")


_SLICES = """SELECT experience_level, count(*) AS n, round(avg(old_label), 2) AS mean_score,
    round(count(*) * 100 / sum(count(*)) OVER (), 1) AS share_pct FROM master
    WHERE experience_level IS NOT NULL GROUP BY experience_level"""


@query("level_slices", over_corpus(_SLICES, MASTER_SQL))
def level_slices(spark, sf_dir):
    return D.level_slices(levelled(spark, sf_dir))


@query("level_top_techs", over_corpus(
    """SELECT experience_level, tech, n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY experience_level ORDER BY n DESC, tech) AS r
       FROM (SELECT experience_level, tech, count(*) AS n FROM (SELECT experience_level, unnest(final_techs) AS tech
             FROM master WHERE experience_level IS NOT NULL) GROUP BY 1, 2)) WHERE r <= 10""", MASTER_SQL))
def level_top_techs(spark, sf_dir):
    return D.level_top_techs(levelled(spark, sf_dir), 10)


@query("level_histogram", over_corpus(
    """SELECT experience_level, old_label AS urgency_score, count(*) AS n FROM master
       WHERE experience_level IS NOT NULL GROUP BY 1, 2""", MASTER_SQL))
def level_histogram(spark, sf_dir):
    return D.level_histogram(levelled(spark, sf_dir))


@query("level_summary", over_corpus(
    f"""SELECT list_position([{", ".join(f"'{v}'" for v in D.LEVELS)}], experience_level) AS place,
        experience_level, mean_score, n FROM ({_SLICES})""", MASTER_SQL))
def level_summary(spark, sf_dir):
    return D.level_summary(levelled(spark, sf_dir))
