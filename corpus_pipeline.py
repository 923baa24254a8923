"""From raw documents to packed training sequences, stage by stage.

Each stage takes all that its predecessor kept, and is written as Parquet in the shared folder and read
again before the next one starts, so that a lost executor costs no more than the stage it was in.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gonggo.llm import decontaminate, jaccard_join, language, packing, suffix_dedup, token_counts
from gonggo.llm.names import fresh
from gonggo.session import arrow_rows, lookup, written

NEAR = jaccard_join.Rule(n=5, num=80, den=100)
VOCABULARY = "byte_bpe_50k.json"
# Whole rows that one Arrow batch holds.
TEXT_ROWS = 1000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without any letter go.

    The model learns from the documents themselves, except one in four, which are held out. Without any
    label to learn from, all documents with a letter stay.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language.learned(docs, ~held_out)
    if model is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    d, t, name = fresh(docs, "d", "t", "language")
    key = F.xxhash64(F.col("text").cast("string"))
    # Only what is rejected is written, by id and text; the batches are bounded while this runs.
    with arrow_rows(spark, TEXT_ROWS):
        found = language.with_language(docs.select("doc_id", "text"), model, out=name)
        rejected = lookup(found.where(F.col(name)["lang"] == language.UNKNOWN).select(
            F.col("doc_id").alias(d), key.alias(t)).distinct())
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col(d)) & (key == F.col(t)), "left_anti").select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Repeated rows of one id and text are copies, too. Documents without words or without an id stay. Of an
    id that has several texts, only those go that are near copies of a document with a smaller id.
    """
    found = jaccard_join.jaccard_components(docs, NEAR, earlier=jaccard_join.EARLIER)
    later = lookup(found.where("n_shingles > 0 AND component_id <> doc_id").select("doc_id", "sid").distinct())
    again = lookup(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = docs.join(later.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    sid, = fresh(docs, "sid")
    several = docs.join(again, "doc_id", "left_semi").withColumn(sid, jaccard_join.set_hash(F.col("text"), NEAR.n))
    several = several.join(later.withColumnRenamed("sid", sid), ["doc_id", sid], "left_anti")
    once = several.where(F.col(sid).isNotNull()).dropDuplicates(["doc_id", "text"])
    return (kept.join(again, "doc_id", "left_anti").select(*docs.columns)
            .unionByName(once.select(*docs.columns))
            .unionByName(several.where(F.col(sid).isNull()).select(*docs.columns)))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes and more that begin earlier; n_chars follows."""
    name, = fresh(docs, "repeats")
    found = suffix_dedup.with_repeats(docs, out=name)
    cut = found.withColumn("text", suffix_dedup.kept_text(F.col("text"), F.col(name)))
    if "n_chars" in docs.columns:
        changed = F.when(F.size(name) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", changed)
    return cut.select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark text."""
    name, = fresh(docs, "contamination")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, benchmark, out=name)
    return found.where(~decontaminate.contaminated(name)).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of the permitted lengths, as lists of documents and their token ranges."""
    with arrow_rows(spark, TEXT_ROWS):
        counted = token_counts.with_token_counts(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
        lengths = written(counted.select("doc_id", "n_tokens"), "lengths")
    return packing.packed(lengths)


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("repeated_passages", without_repeats),
    ("benchmark", uncontaminated),
    ("packing", sequences),
]

# Models, components and packing have no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: one row per training sequence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
