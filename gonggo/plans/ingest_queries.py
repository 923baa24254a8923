"""Merging the three sources, and profiles of the merged table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gonggo.functions.nulls import blank_to_null, nan_to_null
from gonggo.plans.corpus import over_corpus, postings, read
from gonggo.plans.registry import query
from gonggo.session import cut_lineage, shared_folder
from gonggo.sources import postings as S

# order priority -> experience as a jobkorea page words it
EXPERIENCE_WORDS = {
    "1-URGENT": "신입", "2-HIGH": "경력 2년↑", "3-MEDIUM": "경력(4년 이상)",
    "4-NOT SPECIFIED": "신입·경력", "5-LOW": " 경력 12 년 ",
}


def raw_sources(spark, sf_dir, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The corpus (`rows`, if it is at hand) in the shape of the three sites' own files, numbered by row_id."""
    rows = postings(spark, sf_dir) if rows is None else rows

    def of(source):
        return rows.where(F.col("source") == source)
    words = F.create_map(*(x for k, v in EXPERIENCE_WORDS.items() for x in (F.lit(k), F.lit(v))))
    years = F.floor(F.col("o_totalprice") / 60000)
    wanted = of("wanted").select(
        "row_id", "job_id", "company", F.col("title").alias("position"),
        F.col("location").alias("location_perfect"),
        F.when(F.col("qty") == 7, F.lit("")).when(F.col("qty") == 8, F.lit("협의"))
        .when(F.col("qty") > 8, years.cast("double").cast("string")).alias("year_filter"),
        "main_tasks", "requirements", "preferred", "final_techs", "hard_skills")
    jobkorea = of("jobkorea").select(
        "row_id", F.col("job_id").alias("공고번호"), F.col("company").alias("회사명"),
        F.col("title").alias("공고제목"), F.col("location").alias("location_clean"),
        F.when(F.col("qty") == 7, F.lit("  ")).when(F.col("qty") != 8, words[F.col("o_orderpriority")])
        .alias("연차/경력"), F.col("raw_text").alias("상세내용"), "final_techs", "hard_skills")
    saramin = of("saramin").select("row_id", F.col("job_id").alias("공고번호"),
                                   F.col("raw_text").alias("원문"), "final_techs", "hard_skills")
    return wanted, jobkorea, saramin


def master(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    """The merged master table with row_id."""
    return S.merge(*raw_sources(spark, sf_dir, rows), "row_id")


_LEVEL = """CASE source
    WHEN 'wanted' THEN CASE WHEN qty <= 8 THEN '경력무관' WHEN floor(o_totalprice / 60000) <= 0 THEN '신입'
      WHEN floor(o_totalprice / 60000) < 3 THEN '1~3년차' WHEN floor(o_totalprice / 60000) < 5 THEN '3~5년차'
      ELSE '5년이상' END
    WHEN 'jobkorea' THEN CASE WHEN qty IN (7, 8) THEN '경력무관' ELSE CASE o_orderpriority
      WHEN '1-URGENT' THEN '신입' WHEN '2-HIGH' THEN '1~3년차' WHEN '3-MEDIUM' THEN '3~5년차'
      WHEN '5-LOW' THEN '5년이상' ELSE '경력무관' END END END"""
MASTER_SQL = f"""
master AS (
  SELECT row_id, source, job_id, company, title, location, {_LEVEL} AS experience_level, raw_text,
         final_techs, hard_skills, old_label, start_day, end_day, qty, n_lines, brands,
         company_name, title_text, place, o_totalprice, o_orderpriority
  FROM postings)
"""


@query("experience_levels", over_corpus(
    "SELECT row_id, source, experience_level FROM master", MASTER_SQL))
def experience_levels(spark, sf_dir):
    return master(spark, sf_dir).select("row_id", "source", "experience_level")


@query("master_merge", over_corpus(
    """SELECT row_id, source, job_id, company, title, location, experience_level, raw_text,
       array_to_string(final_techs, '|') AS final_techs, array_to_string(hard_skills, '|') AS hard_skills
       FROM master""", MASTER_SQL))
def master_merge(spark, sf_dir):
    return master(spark, sf_dir).select(
        "row_id", "source", "job_id", "company", "title", "location", "experience_level",
        "raw_text", F.concat_ws("|", "final_techs").alias("final_techs"),
        F.concat_ws("|", "hard_skills").alias("hard_skills"))


@query("master_profile", over_corpus(
    """SELECT 'source' AS part, source AS value, count(*) AS n FROM master GROUP BY source
       UNION ALL SELECT 'experience_level', experience_level, count(*) FROM master
       GROUP BY experience_level""", MASTER_SQL))
def master_profile(spark, sf_dir):
    return S.profile_rows(master(spark, sf_dir))


@query("missing_shares", over_corpus(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {e} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2) "
        "AS missing_pct FROM master"
        for c, e in [(c, c if c in ("source", "job_id", "company", "title", "location",
                                    "experience_level", "raw_text", "final_techs", "hard_skills")
                      else "NULL") for c in S.MASTER_COLUMNS]), MASTER_SQL))
def missing_shares(spark, sf_dir):
    return S.missing_shares(master(spark, sf_dir))


@query("list_cells", over_corpus(
    """SELECT row_id, CASE WHEN qty % 10 = 3 THEN '' ELSE array_to_string(final_techs, '|') END AS techs,
       CASE WHEN qty % 10 = 3 THEN 0 ELSE len(final_techs) END AS n FROM postings"""))
def list_cells(spark, sf_dir):
    """Lists written as literal strings are read back; broken cells become empty."""
    rows = postings(spark, sf_dir)
    cell = F.concat(F.lit("['"), F.concat_ws("', '", "final_techs"), F.lit("']"))
    cell = F.when(F.col("qty") % 10 == 3, F.lit("[1, 2")).otherwise(cell)
    return rows.select("row_id", S.parse_list(cell).alias("t")).select(
        "row_id", F.concat_ws("|", "t").alias("techs"), F.size("t").alias("n"))


@query("blank_values",
       """SELECT c_custkey, CASE WHEN c_nationkey < 4 THEN NULL ELSE c_name END AS name,
          CASE WHEN c_nationkey = 5 THEN NULL ELSE c_acctbal END AS balance FROM customer""")
def blank_values(spark, sf_dir):
    """Every spelling of a missing value becomes NULL."""
    customer = read(spark, sf_dir, "customer")
    spelled = (F.when(F.col("c_nationkey") == 0, F.lit(" None ")).when(F.col("c_nationkey") == 1, F.lit("nan"))
               .when(F.col("c_nationkey") == 2, F.lit("　 ")).when(F.col("c_nationkey") == 3, F.lit(""))
               .otherwise(F.col("c_name")))
    number = F.when(F.col("c_nationkey") == 5, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return customer.select("c_custkey", blank_to_null(spelled).alias("name"),
                           nan_to_null(number).alias("balance"))


_FILES = ("wanted_cleaned_techs2.json", "jobkorea_cleaned_techs2.json", "saramin_cleaned_techs2.json")
_ORDER = "CASE source WHEN 'wanted' THEN 0 WHEN 'jobkorea' THEN 1 ELSE 2 END"


@query("ingested_files", over_corpus(
    f"""SELECT source, count(*) AS n, sum(count(*)) OVER (ORDER BY {_ORDER}) - count(*) AS first_id,
        sum(count(*)) OVER (ORDER BY {_ORDER}) - 1 AS last_id, count(*) AS n_ids, 0 AS changed_ids,
        sum(length(raw_text)) AS chars, count(experience_level) AS with_level
        FROM master GROUP BY source""", MASTER_SQL), BIGINT=("n", "first_id", "last_id", "n_ids", "changed_ids", "chars", "with_level"))
def ingested_files(spark, sf_dir):
    """The corpus written as the sites' files of JSON lines and read back twice, in pieces of two sizes, with
    numbers that must be dense and the same."""
    folder = shared_folder(spark, "sources")
    for name, rows in zip(_FILES, raw_sources(spark, sf_dir, cut_lineage(postings(spark, sf_dir)))):
        rows.drop("row_id").write.option("ignoreNullFields", False).json(f"{folder}/{name}")
    once = cut_lineage(S.ingest(spark, folder, lines=True))
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, str(1 << 20))
    try:
        again = cut_lineage(S.ingest(spark, folder, lines=True).select("row_id", F.xxhash64("source", "job_id", "raw_text").alias("other")))
    finally:
        spark.conf.set(size, before)
    both = once.withColumn("mine", F.xxhash64("source", "job_id", "raw_text")).join(again, "row_id", "left")
    long = lambda c, name: c.cast("long").alias(name)
    return both.groupBy("source").agg(
        long(F.count(F.lit(1)), "n"), long(F.min("row_id"), "first_id"), long(F.max("row_id"), "last_id"),
        long(F.count_distinct("row_id"), "n_ids"), long(F.count_if(~F.col("mine").eqNullSafe(F.col("other"))), "changed_ids"),
        long(F.sum(F.length("raw_text")), "chars"), long(F.count("experience_level"), "with_level"))


@query("master_versions", over_corpus(
    """SELECT 'raw' AS version, source, count(*) AS n, 0 AS score, sum(length(raw_text)) AS chars FROM master GROUP BY source
       UNION ALL SELECT 'v5', source, count(*), sum(CASE WHEN source = 'wanted' THEN 10 - old_label ELSE old_label END),
       sum(length(raw_text)) FROM master GROUP BY source""", MASTER_SQL), BIGINT=("n", "score", "chars"))
def master_versions(spark, sf_dir):
    """Two label versions in one table; of the second, one source is then replaced and the others stay."""
    folder = shared_folder(spark, "versions")
    rows = cut_lineage(postings(spark, sf_dir))
    labels = rows.select("row_id", "old_label")
    plain = master(spark, sf_dir, rows).select(*S.MASTER.names)
    scored = cut_lineage(plain.drop("urgency_score").join(labels, "row_id").withColumnRenamed("old_label", "urgency_score").select(*S.MASTER.names))
    S.write_version(plain, folder, "raw")
    S.write_version(scored, folder, "v5")
    S.write_version(scored.where("source = 'wanted'").withColumn("urgency_score", 10 - F.col("urgency_score")), folder, "v5")

    def figures(version):
        return S.read_version(spark, folder, version).groupBy("source").agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("urgency_score"), F.lit(0)).cast("long").alias("score"),
            F.sum(F.length("raw_text")).cast("long").alias("chars")).withColumn("version", F.lit(version))
    return figures("raw").unionByName(figures("v5"))
