"""Reading the three sites' files into one master table, and writing it."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from gonggo.functions.joins import small_side
from gonggo.functions.nulls import nan_to_null
from gonggo.functions.regex import first, stripped

_S, _L = T.StringType(), T.ArrayType(T.StringType())
LIST_COLUMNS = ("final_techs", "hard_skills", "soft_skills", "preferences", "culture_keywords")
_TAIL = [T.StructField(c, _L) for c in LIST_COLUMNS] + [
    T.StructField("urgency_score", T.IntegerType()), T.StructField("urgency_reason", _S)]


def _schema(*strings: str) -> T.StructType:
    return T.StructType([T.StructField(c, _S) for c in strings] + _TAIL)


# Field names of the three files.
WANTED = _schema("job_id", "company", "position", "location_perfect", "year_filter",
                 "main_tasks", "requirements", "preferred")
JOBKOREA = _schema("공고번호", "회사명", "공고제목", "location_clean", "연차/경력", "상세내용")
SARAMIN = _schema("공고번호", "원문")
MASTER = T.StructType([T.StructField("row_id", T.LongType())] + list(_schema(
    "source", "job_id", "company", "title", "location", "experience_level", "raw_text").fields))
MASTER_COLUMNS = tuple(f.name for f in MASTER.fields if f.name != "row_id")
BACKFILL = T.StructType([T.StructField(c, _S) for c in (
    "job_id", "title", "company", "experience_level", "education", "deadline", "location",
    "status")])

# Label versions of the master table.
VERSIONS = {
    "raw": "master_merged", "v2": "master_merged_v2", "v3": "master_merged_v3",
    "v4": "master_merged_v4", "v5": "master_merged_v5",
}


def master_path(folder: str, version: str = "v5") -> str:
    if version not in VERSIONS:
        raise ValueError(f"unknown label version {version!r}; known: {', '.join(VERSIONS)}")
    return os.path.join(folder, VERSIONS[version])


def read_json(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """A JSON array file or a folder of them; with `lines`, one object a line, which many tasks read in pieces.

    Adds where a row comes from: _file, _block (first byte of the piece) and _at (growing inside a piece).
    """
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_at"))


PLACE = ("_file", "_block", "_at")


def with_row_id(df: DataFrame, order: str = "source_no", out: str = "row_id") -> DataFrame:
    """Numbers rows that `read_json` read, 0, 1, 2 ... by `order`, file and place in the file.

    (source, job_id) is not a key, so everything later is joined by this number. Each piece of a file is
    counted first; the pieces before it give its offset. So the numbers have no gaps and depend on
    nothing but the files: however often they are read, and in whatever pieces, they are the same.
    """
    piece = [order, "_file", "_block"]
    counts = df.groupBy(*piece).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    # one row per piece of a file, so this window and the lookup stay small
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rows = df.join(small_side(offsets), piece)
    return rows.select((F.col("_before") + F.col("_at") - F.col("_first")).alias(out),
                       *(c for c in df.columns if c not in (order, *PLACE)))


# ---------------------------------------------------------------- experience levels

def wanted_level(year_filter: Column) -> Column:
    """Years asked for -> level; missing or unreadable means any."""
    years = nan_to_null(stripped(year_filter.cast("string")).try_cast("double"))
    unread = stripped(F.lower(year_filter.cast("string"))).isin("nan", "+nan", "-nan")
    return (F.when(unread, "5년이상")        # not a number compares as neither small nor medium
            .when(years <= 0, "신입").when(years < 3, "1~3년차").when(years < 5, "3~5년차")
            .when(years.isNotNull(), "5년이상").otherwise("경력무관"))


def jobkorea_level(text: Column) -> Column:
    """Free text -> level: whole words first, then the first number of years."""
    word = stripped(text)
    years = first(word, r"(\d+)\s*년").try_cast("decimal(38,0)")
    return (F.when(word == "신입", "신입").when(word.isin("경력무관", "경력", "신입·경력"), "경력무관")
            .when(years <= 2, "1~3년차").when(years <= 4, "3~5년차")
            .when(years.isNotNull(), "5년이상").otherwise("경력무관"))


def join_text(*parts: Column) -> Column:
    """The parts that are not empty, with a blank line between."""
    return F.concat_ws("\n\n", *(F.nullif(p, F.lit("")) for p in parts))


# ---------------------------------------------------------------- the three sources

def _tail(df: DataFrame) -> list[Column]:
    types = {f.name: f.dataType for f in _TAIL}
    return [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
            for c, t in types.items()]


def _none(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def from_wanted(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(
        *keep, F.lit("wanted").alias("source"), F.col("job_id").cast("string").alias("job_id"),
        "company", F.col("position").alias("title"), F.col("location_perfect").alias("location"),
        wanted_level(F.col("year_filter")).alias("experience_level"),
        join_text(F.col("main_tasks"), F.col("requirements"), F.col("preferred")).alias("raw_text"),
        *_tail(df))


def from_jobkorea(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(
        *keep, F.lit("jobkorea").alias("source"), F.col("공고번호").cast("string").alias("job_id"),
        F.col("회사명").alias("company"), F.col("공고제목").alias("title"),
        F.col("location_clean").alias("location"),
        jobkorea_level(F.col("`연차/경력`")).alias("experience_level"),
        F.col("상세내용").alias("raw_text"), *_tail(df))


def from_saramin(df: DataFrame, *keep: str) -> DataFrame:
    """This site's file has no title, company, place or level: NULL by design."""
    return df.select(
        *keep, F.lit("saramin").alias("source"), F.col("공고번호").cast("string").alias("job_id"),
        _none("company"), _none("title"), _none("location"), _none("experience_level"),
        F.col("원문").alias("raw_text"), *_tail(df))


def merge(wanted: DataFrame, jobkorea: DataFrame, saramin: DataFrame, *keep: str) -> DataFrame:
    """The master table, in the order wanted, jobkorea, saramin."""
    return (from_wanted(wanted, *keep).unionByName(from_jobkorea(jobkorea, *keep))
            .unionByName(from_saramin(saramin, *keep)))


def ingest(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """The three JSON files (or, with `lines`, files or folders of JSON lines) of a folder as one numbered master table."""
    files = {"wanted_cleaned_techs2.json": WANTED, "jobkorea_cleaned_techs2.json": JOBKOREA,
             "saramin_cleaned_techs2.json": SARAMIN}
    parts = [read_json(spark, os.path.join(folder, n), s, lines).withColumn("source_no", F.lit(i))
             for i, (n, s) in enumerate(files.items())]
    return with_row_id(merge(*parts, "source_no", *PLACE))


def write_master(df: DataFrame, folder: str, version: str) -> None:
    """Parquet, one folder per label version and in it one per source."""
    df.write.mode("overwrite").partitionBy("source").parquet(master_path(folder, version))


def write_master_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_master(spark: SparkSession, folder: str, version: str = "v5") -> DataFrame:
    return spark.read.schema(MASTER).parquet(master_path(folder, version))


def write_version(df: DataFrame, folder: str, version: str) -> None:
    """Rows of one label version into a table of all versions: of that version, the sources that `df` holds
    are replaced, everything else stays."""
    master_path(folder, version)
    (df.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("version", "source").parquet(os.path.join(folder, "master_versions")))


def read_version(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """One version of that table; only its folders are read. A version that is not there is an error."""
    master_path(folder, version)
    table = spark.read.schema(T.StructType([*MASTER.fields, T.StructField("version", _S)])).parquet(
        os.path.join(folder, "master_versions"))
    rows = table.where(F.col("version") == version).drop("version")
    if rows.isEmpty():
        raise ValueError(f"label version {version!r} has not been written")
    return rows


# ---------------------------------------------------------------- lists and profiles

def parse_list(cell: Column) -> Column:
    """A list written as a literal string -> array; anything else -> empty.

    Reads quoted items with either quote mark, as they appear in the files.
    """
    whole = stripped(cell)
    listed = whole.rlike(r"(?s)\A\[.*\]\z")
    items = F.regexp_extract_all(
        whole, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    plain = F.transform(items, lambda s: F.regexp_replace(
        F.substring(s, F.lit(2), F.length(s) - 2), r"\\(.)", "$1"))
    return F.when(listed, plain).otherwise(F.array().cast("array<string>"))


def profile_rows(df: DataFrame) -> DataFrame:
    """(part, value, n): rows per source and per experience level, NULL included."""
    def counts(column):
        return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")) \
            .select(F.lit(column).alias("part"), "value", "n")
    return counts("source").unionByName(counts("experience_level"))


def missing_shares(df: DataFrame, columns=MASTER_COLUMNS) -> DataFrame:
    """(column_name, missing_pct) in one pass over the table."""
    row = df.agg(*(F.round(F.avg(F.col(c).isNull().cast("double")) * 100, 2).alias(c)
                   for c in columns))
    return row.select(F.inline(F.array(*(
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_pct")) for c in columns))))
