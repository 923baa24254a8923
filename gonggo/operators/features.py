"""Feature columns: weighted word vectors, sizes, class weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, StandardScaler, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gonggo.operators.textprep import tokens_of
from gonggo.operators.urgency_words import FEATURE_NAMES

LIST_COLUMNS = ("final_techs", "hard_skills", "soft_skills", "preferences", "culture_keywords")


def terms_of(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Words and neighbouring pairs of words, in text order."""
    words = tokens_of(text)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def term_counts(df: DataFrame, terms: str = "terms") -> DataFrame:
    """(term, df, cf): documents and occurrences, in one pre-aggregated pass.

    Terms are sorted inside each row; the first of equal neighbours stands for
    the document.
    """
    ordered = df.select(F.sort_array(terms).alias("_t"))
    marked = ordered.select(F.explode(F.transform("_t", lambda t, i: F.struct(
        t.alias("term"),
        ((i == 0) | (F.get("_t", i - 1) != t)).cast("int").alias("first")))).alias("x"))
    return marked.groupBy("x.term").agg(F.sum("x.first").alias("df"), F.count(F.lit(1)).alias("cf"))


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary (at most max_features terms) with its idf weights."""
    vocabulary: tuple
    idf: tuple
    stop_words: tuple = ()

    @property
    def size(self) -> int:
        return len(self.vocabulary)

    def transform(self, df: DataFrame, text: str, out: str = "tfidf") -> DataFrame:
        """Adds the unit-length vector of (1 + ln tf) x idf.

        Counting against the vocabulary is done by the JVM; a small Arrow
        function scales the counted entries of a batch.
        """
        counter = CountVectorizerModel.from_vocabulary(list(self.vocabulary), "_terms", "_tf")
        idf, size = np.array(self.idf), self.size

        def weighted(counted: pa.Array) -> pa.Array:
            at, counts, n = counted.field("indices"), counted.field("values"), len(counted)
            ends = counts.offsets.to_numpy() - counts.offsets[0].as_py()
            values = (1 + np.log(counts.flatten().to_numpy())) * idf[at.flatten().to_numpy()]
            squares = values * values
            norms = np.sqrt([squares[a:b].sum() for a, b in zip(ends[:-1], ends[1:])])
            values = values / np.repeat(np.where(norms > 0, norms, 1.0), np.diff(ends))
            return pa.StructArray.from_arrays(
                [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), at,
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
                names=["type", "size", "indices", "values"])
        scale = F.arrow_udf(weighted, VectorUDT())
        counted = counter.transform(
            df.withColumn("_terms", terms_of(F.col(text), self.stop_words)))
        return counted.withColumn(out, scale(F.unwrap_udt("_tf"))).drop("_terms", "_tf")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(i, t, float(w)) for i, (t, w) in enumerate(zip(self.vocabulary, self.idf))],
            "position int, term string, idf double")


def vocabulary_table(df: DataFrame, text: str, max_features: int = 30_000, min_df: int = 5,
                     max_df: float = 0.9, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(term, df, cf, idf) of the terms kept: in at least min_df documents and at
    most max_df of them, the max_features most frequent, ties by name."""
    terms = df.select(terms_of(F.col(text), stop_words).alias("terms"))
    rows = df.agg(F.count(F.lit(1)).alias("c"))
    counts = term_counts(terms).withColumn("_n", rows.scalar())
    kept = (counts.where((F.col("df") >= min_df) & (F.col("df") <= F.col("_n") * F.lit(max_df)))
            .orderBy(F.desc("cf"), "term").limit(max_features))
    return kept.select("term", "df", "cf",
                       (F.log((F.col("_n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def fit_tfidf(df: DataFrame, text: str, max_features: int = 30_000, min_df: int = 5,
              max_df: float = 0.9, stop_words: tuple[str, ...] = ()) -> TfidfModel:
    """At most max_features rows come to the driver: the model itself."""
    rows = (vocabulary_table(df, text, max_features, min_df, max_df, stop_words)
            .orderBy("term").select("term", "idf").collect())
    if not rows:
        raise ValueError("no term is in enough documents")
    return TfidfModel(tuple(r[0] for r in rows), tuple(r[1] for r in rows), tuple(stop_words))


# ---------------------------------------------------------------- other features

def aux_features(df: DataFrame, text: str = "raw_text", lists=LIST_COLUMNS) -> DataFrame:
    """Sizes of the lists and of the text; a missing list counts 0."""
    raw = F.coalesce(F.col(text), F.lit(""))
    sizes = {c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)) if c in df.columns
             else F.lit(0) for c in lists}
    total = sum(sizes.values(), F.lit(0))
    return df.select(
        "*", *(s.alias("n_" + c) for c, s in sizes.items()), total.alias("n_skills_total"),
        F.length(raw).alias("len_raw_text"),
        (F.regexp_count(raw, F.lit("\n")) + 1).alias("n_lines"),
        F.regexp_count(raw, F.lit(r"\p{Nd}")).alias("n_digits"))


AUX_NAMES = tuple("n_" + c for c in LIST_COLUMNS) + (
    "n_skills_total", "len_raw_text", "n_lines", "n_digits")


def scaled(train: DataFrame, others: list[DataFrame], names=AUX_NAMES, out: str = "aux"):
    """Vectors of the named columns, centred and scaled by the training rows."""
    assembler = VectorAssembler(inputCols=list(names), outputCol="_aux")
    scaler = StandardScaler(inputCol="_aux", outputCol=out, withMean=True, withStd=True)
    model = scaler.fit(assembler.transform(train))
    return [model.transform(assembler.transform(d)).drop("_aux") for d in [train, *others]]


def struct_columns() -> list[str]:
    return ["f_" + n for n in FEATURE_NAMES]


def stacked(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out).transform(df)


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """(label, n, weight): rows / (classes x rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    figures = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k")).alias("s"))
    s = counts.withColumn("_s", figures.scalar())
    return s.select(label, "n", (F.col("_s.rows") / (F.col("_s.k") * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str = "y", out: str = "weight") -> DataFrame:
    """Weights of a handful of classes, written into the plan as a lookup."""
    rows = class_weights(df, label).collect()
    table = F.create_map(*(x for r in rows for x in (F.lit(r[label]), F.lit(float(r["weight"])))))
    return df.withColumn(out, table[F.col(label)])
