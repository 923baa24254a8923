"""Technology names found in, and brought together over, the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from gonggo.operators import techs as T
from gonggo.operators.tech_words import STOP_WORDS, default_aliases
from gonggo.plans.corpus import BRAND_TECHS, TYPE_SKILLS, over_corpus, postings, read
from gonggo.plans.registry import query

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_KNOWN = "['" + "', '".join(t for t, _ in BRAND_TECHS if t not in STOP_WORDS) + "']"
_NAMES = "[" + ", ".join(f"'{t}'" for t, _ in BRAND_TECHS) + "]"

# what a reader finds in the text: the brands' technologies, plus the one named
# in the tail of every jobkorea page
FOUND_SQL = f"""
found AS (SELECT *, list_sort(list_filter(list_concat(
    list_transform(brands, lambda b: ({_NAMES})[b]),
    CASE WHEN source = 'jobkorea' THEN ['Hadoop'] ELSE [] END), lambda t: list_contains({_KNOWN} || ['Hadoop'], t)))
    AS text_techs FROM postings)
"""
_SKILLS = ", ".join(f"('{s}', {repr(c) if c else 'NULL'})" for s, c in TYPE_SKILLS.values())
# listed names: final_techs and hard_skills, each with its canonical name
LISTED_SQL = f"""
skill_names(name, tech) AS (VALUES {_SKILLS}, {", ".join(f"('{t}', {repr(t) if t not in STOP_WORDS else 'NULL'})" for t, _ in BRAND_TECHS)}),
listed AS (SELECT row_id, unnest(list_distinct(list_concat(final_techs, hard_skills))) AS name FROM postings),
split AS (SELECT row_id, list_sort(list_distinct(list(tech) FILTER (tech IS NOT NULL))) AS techs,
    list_sort(list_distinct(list(lower(name)) FILTER (tech IS NULL))) AS extras
  FROM listed JOIN skill_names USING (name) GROUP BY row_id),
skilled AS (SELECT f.*, list_sort(list_distinct(list_concat(coalesce(s.techs, []), text_techs))) AS techs,
    coalesce(s.extras, []) AS skills_extra FROM found f LEFT JOIN split s USING (row_id))
"""


def skilled(spark, sf_dir):
    """The corpus with techs and skills_extra."""
    return T.with_techs(postings(spark, sf_dir))


@query("tech_extraction", over_corpus(
    "SELECT row_id, array_to_string(text_techs, '|') AS techs FROM found", FOUND_SQL))
def tech_extraction(spark, sf_dir):
    rows = postings(spark, sf_dir)
    return rows.select("row_id", T.extract_techs(F.col("raw_text")).alias("t")).select(
        "row_id", F.concat_ws("|", "t").alias("techs"))


_ALIASES = ", ".join(f"('{a}', '{t}')" for a, t in sorted(T.DEFAULT.aliases.items()))


@query("document_techs", f"""SELECT tech, count(*) AS n FROM (SELECT DISTINCT doc_id, tech
    FROM documents, (VALUES {_ALIASES}) a(alias, tech) WHERE contains(lower(text), alias)
      AND regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_escape(alias) || '($|[^a-z0-9])')) GROUP BY tech""")
def document_techs(spark, sf_dir):
    """Technologies named in the documents, whole texts."""
    docs = read(spark, sf_dir, "documents")
    return (docs.select("doc_id", F.explode(T.extract_techs(F.col("text"))).alias("tech"))
            .groupBy("tech").agg(F.count(F.lit(1)).alias("n")))


@query("canonical_skills", over_corpus(
    "SELECT DISTINCT name, tech FROM listed JOIN skill_names USING (name)", LISTED_SQL.split("split AS")[0].rstrip().rstrip(",")))
def canonical_skills(spark, sf_dir):
    names = postings(spark, sf_dir).select(
        F.explode(F.concat("final_techs", "hard_skills")).alias("name"))
    return T.canonical_names(names).select("name", "tech")


@query("normalized_lists", over_corpus(
    """SELECT row_id, array_to_string(list_sort(list_distinct(list(tech))), '|') AS techs
       FROM listed JOIN skill_names USING (name) WHERE tech IS NOT NULL GROUP BY row_id""",
    LISTED_SQL.split("split AS")[0].rstrip().rstrip(",")))
def normalized_lists(spark, sf_dir):
    out = T.normalize_list(postings(spark, sf_dir), ["final_techs", "hard_skills"])
    return out.select("row_id", F.concat_ws("|", "techs").alias("techs"))


@query("split_skills", over_corpus(
    """SELECT row_id, array_to_string(coalesce(techs, []), '|') AS techs,
       array_to_string(coalesce(extras, []), '|') AS skills_extra FROM split""",
    LISTED_SQL.split("skilled AS")[0].rstrip().rstrip(",")))
def split_skills(spark, sf_dir):
    out = T.split_skills(postings(spark, sf_dir), ["final_techs", "hard_skills"])
    return out.select("row_id", F.concat_ws("|", "techs").alias("techs"),
                      F.concat_ws("|", "skills_extra").alias("skills_extra"))


@query("posting_techs", over_corpus(
    """SELECT row_id, array_to_string(techs, '|') AS techs,
       array_to_string(skills_extra, '|') AS skills_extra FROM skilled""", FOUND_SQL, LISTED_SQL))
def posting_techs(spark, sf_dir):
    return skilled(spark, sf_dir).select("row_id", F.concat_ws("|", "techs").alias("techs"),
                                         F.concat_ws("|", "skills_extra").alias("skills_extra"))


@query("stop_words_removed", over_corpus(
    f"""SELECT row_id, array_to_string(list_filter(list_sort(list_distinct(final_techs)),
        lambda t: NOT list_contains({_STOP}, t)), '|') AS techs FROM postings"""))
def stop_words_removed(spark, sf_dir):
    kept = T.DEFAULT.without_stop_words(F.sort_array(F.array_distinct("final_techs")))
    return postings(spark, sf_dir).select("row_id", F.concat_ws("|", kept).alias("techs"))


@query("hypernyms", over_corpus(
    """SELECT row_id, array_to_string(list_sort(list_distinct(list_concat(techs,
       CASE WHEN list_contains(techs, 'Spring Boot') THEN ['Spring'] ELSE [] END))), '|') AS techs FROM skilled""",
    FOUND_SQL, LISTED_SQL))
def hypernyms(spark, sf_dir):
    return skilled(spark, sf_dir).select(
        "row_id", F.concat_ws("|", T.expand_hypernyms(F.col("techs"))).alias("techs"))


@query("alias_usage", over_corpus(
    "SELECT tech, count(*) AS aliases, count(*) FILTER (used) AS used FROM (SELECT a.tech, a.alias IN (SELECT DISTINCT lower(w) FROM (SELECT unnest(string_split(words, ' / ')) AS w FROM parts)) AS used FROM (VALUES "
    + ", ".join(f"('{a}', '{t}')" for a, t in sorted(default_aliases().items()))
    + ") a(alias, tech)) GROUP BY tech"))
def alias_usage(spark, sf_dir):
    """Aliases per technology, and how many of them are words of the corpus."""
    words = (postings(spark, sf_dir).select(F.explode(F.array_distinct("brands")).alias("b")).distinct()
             .select(F.lower(F.array(*(F.lit(s) for _, s in BRAND_TECHS))[F.col("b") - 1]).alias("alias")))
    table = T.DEFAULT.table(spark)
    return (table.join(words.withColumn("hit", F.lit(1)), "alias", "left").groupBy("tech")
            .agg(F.count(F.lit(1)).alias("aliases"), F.count("hit").alias("used")))
