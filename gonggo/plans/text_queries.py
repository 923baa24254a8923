"""Masking, templates, copies and splits over documents and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gonggo.operators import textprep as X
from gonggo.operators import urgency_words as W
from gonggo.plans.corpus import over_corpus, postings, read
from gonggo.plans.match_queries import _hash
from gonggo.plans.registry import query


def documents(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("raw_text"), "source", "lang")


def _masked(column: str) -> str:
    return f"regexp_replace({column}, '{X.LABEL_PATTERN}', '{X.MASK}', 'g')"


def _marks(column: str) -> str:
    return f"len(regexp_extract_all({column}, '{X.LABEL_PATTERN}'))"


def _clean(column: str) -> str:
    cut = column
    for marker in W.TAIL_MARKERS:
        cut = f"split_part({cut}, '{marker}', 1)"
    jobkorea = f"regexp_replace(regexp_replace({cut}, '{W.DISCLAIMER}', ' ', 'g'), '{X.JOBKOREA_FURNITURE}', ' ', 'g')"
    saramin = f"regexp_replace({column}, '{X.SARAMIN_FURNITURE}', ' ', 'g')"
    own = f"CASE source WHEN 'jobkorea' THEN {jobkorea} WHEN 'saramin' THEN {saramin} ELSE {column} END"
    return f"trim(regexp_replace(regexp_replace({own}, '{X.BRANDS.replace('(?iu)', '(?i)')}', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("masked_texts", over_corpus(
    f"SELECT row_id, {_masked('raw_text')} AS masked FROM postings"))
def masked_texts(spark, sf_dir):
    return postings(spark, sf_dir).select("row_id", X.mask_text(F.col("raw_text")).alias("masked"))


@query("document_masking", """
    SELECT doc_id AS row_id, len(regexp_extract_all(text, '(?i)license|copyright|[0-9]{3,}|[a-z0-9._]+@[a-z0-9.]+')) AS marks,
      md5(regexp_replace(text, '(?i)license|copyright|[0-9]{3,}|[a-z0-9._]+@[a-z0-9.]+', ' <MASK> ', 'g')) AS masked
    FROM documents""")
def document_masking(spark, sf_dir):
    """The same masking with a pattern that meets the documents: notices, numbers, addresses."""
    pattern = r"(?i)license|copyright|[0-9]{3,}|[a-z0-9._]+@[a-z0-9.]+"
    docs = documents(spark, sf_dir)
    return docs.select("row_id", F.regexp_count("raw_text", F.lit(pattern)).alias("marks"),
                       F.md5(X.mask_text(F.col("raw_text"), pattern)).alias("masked"))


@query("stripped_templates", over_corpus(
    f"SELECT row_id, {_clean('raw_text')} AS stripped FROM postings"))
def stripped_templates(spark, sf_dir):
    return postings(spark, sf_dir).select("row_id", X.strip_template(
        F.col("raw_text"), F.col("source")).alias("stripped"))


@query("text_variants", over_corpus(
    f"""SELECT row_id, md5(raw_text) AS "full", md5({_masked('raw_text')}) AS masked, md5(clean) AS clean,
        md5({_masked('clean')}) AS masked_clean FROM (SELECT *, {_clean('raw_text')} AS clean FROM postings)"""))
def text_variants(spark, sf_dir):
    rows = postings(spark, sf_dir)
    return rows.select("row_id", *(
        F.md5(X.apply_variant(F.col("raw_text"), F.col("source"), v)).alias(v.replace("+", "_"))
        for v in X.VARIANTS))


@query("overlap_report", over_corpus(
    f"""SELECT coalesce(sum(removed), 0) AS removed_chars, coalesce(sum(greatest(0, {_marks('raw_text')} - {_marks('clean')})), 0)
        AS label_matches_removed FROM (SELECT raw_text, clean, length(raw_text) - length(clean) AS removed
        FROM (SELECT raw_text, {_clean('raw_text')} AS clean FROM postings)) WHERE removed > 0"""),
       BIGINT=("removed_chars", "label_matches_removed"))
def overlap_report(spark, sf_dir):
    return X.overlap_report(postings(spark, sf_dir))


def _source_words_sql(rows: str, source: str, protected: tuple[str, ...], min_share, min_gap) -> str:
    guard = "".join(f" AND NOT contains(token, '{w}')" for w in protected)
    return f"""words AS (SELECT {source} AS source, unnest(list_distinct(regexp_extract_all(lower(raw_text), '{X.TOKEN}'))) AS token FROM {rows}),
      sizes AS (SELECT {source} AS source, count(*) AS size FROM {rows} GROUP BY 1),
      frequent AS (SELECT token FROM words GROUP BY token HAVING count(*) >= 10 ORDER BY count(*) DESC, token LIMIT 80000),
      shares AS (SELECT f.token, s.source, count(w.token) / any_value(size) AS share FROM frequent f CROSS JOIN sizes s
        LEFT JOIN words w ON w.token = f.token AND w.source = s.source GROUP BY 1, 2),
      gaps AS (SELECT token, max(share) AS hi, max(share) - min(share) AS gap FROM shares GROUP BY token)
      SELECT token, round(gap, 9) AS gap FROM gaps WHERE hi >= {min_share} AND gap >= {min_gap}{guard}
      ORDER BY gap DESC, token LIMIT 3000"""


@query("source_stop_words", over_corpus("").rstrip() + ", "
       + _source_words_sql("postings", "source", X.label_tokens(), 0.5, 0.4))
def source_stop_words(spark, sf_dir):
    words = X.source_stop_words(postings(spark, sf_dir), "raw_text")
    return words.select("token", F.round("gap", 9).alias("gap"))


@query("language_words", "WITH docs AS (SELECT doc_id, text AS raw_text, lang FROM documents), "
       + _source_words_sql("docs", "lang", (), 0.5, 0.4))
def language_words(spark, sf_dir):
    """The same statistic on documents: words of one language."""
    words = X.source_stop_words(documents(spark, sf_dir), "raw_text", "lang", protected=())
    return words.select("token", F.round("gap", 9).alias("gap"))


# ---------------------------------------------------------------- copies

_NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_KEYS = f"keyed AS (SELECT doc_id, source, text, md5({_NORM}) AS copy_key, md5(left({_NORM}, 600)) AS near_key FROM documents)"
_KEPT = "kept AS (SELECT * FROM keyed WHERE doc_id IN (SELECT min(doc_id) FROM keyed GROUP BY copy_key))"


@query("exact_copies_dropped", f"WITH {_KEYS}, {_KEPT} SELECT doc_id AS row_id, copy_key, near_key FROM kept")
def exact_copies_dropped(spark, sf_dir):
    return X.drop_exact_copies(documents(spark, sf_dir)).select("row_id", "copy_key", "near_key")


@query("copy_stats", f"""WITH {_KEYS}, {_KEPT} SELECT (SELECT count(*) FROM keyed) AS rows_before, count(*) AS rows_after,
    (SELECT count(*) FROM keyed) - count(*) AS exact_dup_rows_removed, count(DISTINCT near_key) AS n_groups,
    count(*) FILTER (near_key IN (SELECT near_key FROM kept GROUP BY 1 HAVING count(*) > 1)) AS grouped_rows FROM kept""")
def copy_stats(spark, sf_dir):
    return X.copy_stats(documents(spark, sf_dir))


@query("posting_copies", over_corpus("""
    SELECT count(*) AS rows_before, count(DISTINCT k) AS rows_after, count(*) - count(DISTINCT k) AS exact_dup_rows_removed
    FROM (SELECT md5(lower(trim(regexp_replace(raw_text, '\\s+', ' ', 'g')))) AS k FROM postings)"""))
def posting_copies(spark, sf_dir):
    return X.copy_stats(postings(spark, sf_dir)).select(
        "rows_before", "rows_after", "exact_dup_rows_removed")


# ---------------------------------------------------------------- splits

_STRATA = """counts AS (SELECT source, source || '__' || lang AS own, count(*) AS n FROM documents GROUP BY ALL),
  big AS (SELECT * FROM counts WHERE n >= 12),
  strata AS (SELECT source, own, CASE WHEN n >= 12 THEN own ELSE coalesce(
      (SELECT b.own FROM big b WHERE b.source = c.source ORDER BY n DESC, own DESC LIMIT 1),
      (SELECT b.own FROM big b ORDER BY n DESC, own DESC LIMIT 1), own) END AS stratum FROM counts c)"""


def strata(spark, sf_dir) -> DataFrame:
    return X.absorb_rare(documents(spark, sf_dir), "lang", least=12)


@query("absorbed_strata", f"""WITH {_STRATA} SELECT stratum, count(*) AS n FROM documents d
    JOIN strata s ON s.own = d.source || '__' || d.lang GROUP BY stratum""")
def absorbed_strata(spark, sf_dir):
    return strata(spark, sf_dir).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


_SPLIT = f"""owners AS (SELECT near_key, max(own) AS s FROM (SELECT near_key, stratum AS own, count(*) AS n,
      max(count(*)) OVER (PARTITION BY near_key) AS top FROM stratified GROUP BY 1, 2) WHERE n = top GROUP BY 1),
  placed AS (SELECT near_key, (row_number() OVER (PARTITION BY s ORDER BY {_hash("'42'", 'near_key')}, near_key) - 1) % 25 AS turn FROM owners),
  splits AS (SELECT near_key, CASE WHEN turn % 5 = 0 THEN 'test' WHEN turn // 5 = turn % 5 THEN 'val' ELSE 'train' END AS split FROM placed)"""


def grouped(spark, sf_dir) -> DataFrame:
    """Documents without exact copies, with near_key and stratum, split by group."""
    kept = X.drop_exact_copies(documents(spark, sf_dir))
    return X.group_split(X.absorb_rare(kept, "lang", least=12))


_STRATA_KEPT = _STRATA.replace("FROM documents", "FROM kept")


_LANG = "(SELECT lang FROM documents d WHERE d.doc_id = keyed.doc_id) AS lang"
_SPLITS = f"""WITH {_KEYS}, {_KEPT.replace('SELECT *', 'SELECT keyed.*, ' + _LANG)}, {_STRATA_KEPT},
    stratified AS (SELECT k.doc_id, k.near_key, s.stratum FROM kept k JOIN strata s ON s.own = k.source || '__' || k.lang),
    {_SPLIT}"""


@query("group_split", f"{_SPLITS} SELECT doc_id AS row_id, split FROM kept JOIN splits USING (near_key)")
def group_split(spark, sf_dir):
    return grouped(spark, sf_dir).select("row_id", "split")


@query("shared_groups", f"""{_SPLITS} SELECT count(*) AS shared_groups FROM (
    SELECT near_key FROM kept JOIN splits USING (near_key) GROUP BY near_key HAVING count(DISTINCT split) > 1)""")
def shared_groups(spark, sf_dir):
    """Groups found in more than one part; must be none."""
    return X.shared_groups(grouped(spark, sf_dir))


@query("stratified_split", f"""WITH {_STRATA} SELECT doc_id AS row_id, stratum, CASE WHEN row_number() OVER (
      PARTITION BY stratum ORDER BY {_hash("'42'", 'doc_id')}, doc_id) <= round(count(*) OVER (PARTITION BY stratum) * CAST(0.2 AS DOUBLE))
      THEN 'test' ELSE 'train' END AS split FROM documents d JOIN strata s ON s.own = d.source || '__' || d.lang""")
def stratified_split(spark, sf_dir):
    return X.stratified_split(strata(spark, sf_dir), "stratum").select("row_id", "stratum", "split")


@query("sampled_rows", f"""SELECT row_id, source FROM (SELECT doc_id AS row_id, source, row_number() OVER (
    ORDER BY {_hash("'42'", 'doc_id')}, doc_id) AS r FROM documents) WHERE r <= 300""")
def sampled_rows(spark, sf_dir):
    """A fixed number of documents, chosen repeatably."""
    return X.sample_rows(documents(spark, sf_dir), 300).select("row_id", "source")
