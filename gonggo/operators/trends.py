"""Demand, co-occurrence, region and experience-level statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gonggo.functions.joins import small_side
from gonggo.operators.techs import DEFAULT, TechDictionary

# Experience levels in display order.
LEVELS = ("신입", "1~3년차", "3~5년차", "5년이상", "경력무관")


def of_sources(df: DataFrame, sources) -> DataFrame:
    return df.where(F.col("source").isin(*sources)) if sources else df


def tech_frequency(df: DataFrame, techs: str = "final_techs", by: list[str] | None = None) -> DataFrame:
    """Mentions per technology; repeats inside one posting count."""
    by = by or []
    return (df.select(*by, F.explode(techs).alias("tech"))
            .groupBy(*by, "tech").agg(F.count(F.lit(1)).alias("n")))


def top_techs(counts: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The n most frequent, equal counts in name order."""
    if not by:
        return counts.orderBy(F.desc("n"), "tech").limit(n)
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "tech")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def headline_figures(df: DataFrame, techs: str = "final_techs") -> DataFrame:
    """Postings, distinct technologies, sources.

    Three small counts joined as scalar subqueries; the distinct counts are
    plain two-step aggregates, so no group is held whole.
    """
    n_techs = df.select(F.explode(techs).alias("tech")).distinct().agg(F.count(F.lit(1)).alias("c"))
    n_sources = df.select("source").where("source is not null").distinct() \
        .agg(F.count(F.lit(1)).alias("c"))
    return df.agg(F.count(F.lit(1)).alias("postings")).select(
        "postings", n_techs.scalar().alias("distinct_techs"), n_sources.scalar().alias("sources"))


def posting_sets(df: DataFrame, techs: str = "final_techs", exclude_stop_words: bool = True,
                 dictionary: TechDictionary = DEFAULT, keep=("row_id",)) -> DataFrame:
    """Technologies of each posting as a sorted set; postings left empty are dropped."""
    names = F.array_distinct(F.col(techs))
    if exclude_stop_words:
        names = dictionary.without_stop_words(names)
    return (df.select(*keep, F.sort_array(names).alias("techs")).where(F.size("techs") > 0))


def document_frequency(sets: DataFrame) -> DataFrame:
    return tech_frequency(sets, "techs")


def universe_of(sets: DataFrame, size: int = 50) -> DataFrame:
    """The technologies co-occurrence is measured on: the most frequent ones."""
    return top_techs(document_frequency(sets), size).select("tech")


def related_techs(sets: DataFrame, base: str, universe: DataFrame) -> DataFrame:
    """Technologies required together with `base`: count, match count, rate in %.

    The base's own count is the number of postings holding it, so one pass over
    the matching postings gives both figures.
    """
    held = sets.where(F.array_contains("techs", base))
    counts = held.select(F.explode("techs").alias("tech")).groupBy("tech") \
        .agg(F.count(F.lit(1)).alias("n"))
    matched = counts.where(F.col("tech") == base).select("n")
    return (counts.where(F.col("tech") != base)
            .join(universe, "tech", "left_semi")
            .select("tech", "n", matched.scalar().alias("match_count"))
            .withColumn("rate_pct", F.round(F.col("n") * 100 / F.col("match_count"), 1)))


def companions(related: DataFrame) -> DataFrame:
    """Mean number of companions per matching posting (NULL without matches)."""
    return related.agg(
        F.count(F.lit(1)).alias("related_techs"), F.max("match_count").alias("match_count"),
        F.try_divide(F.sum("n"), F.max("match_count")).alias("mean_companions"))


def cooccurrence(sets: DataFrame, universe: DataFrame) -> DataFrame:
    """(base, tech, n, match_count) for every base in the universe.

    Equal sets are counted once and weighted, a set is held to the universe
    before it is paired with itself (at most universe x universe pairs, summed
    before the shuffle).
    """
    weighted = sets.groupBy("techs").agg(F.count(F.lit(1)).alias("w"))
    bases = (weighted.select("w", "techs", F.explode("techs").alias("base"))
             .join(small_side(universe.select(F.col("tech").alias("base"))), "base"))
    return (bases.select("base", "w", F.explode("techs").alias("tech"))
            .join(small_side(universe), "tech")
            .groupBy("base", "tech").agg(F.sum("w").alias("n"))
            .select("base", "tech", "n",
                    F.max(F.when(F.col("base") == F.col("tech"), F.col("n")))
                    .over(Window.partitionBy("base")).alias("match_count"))
            .where("base <> tech"))


def related_map(pairs: DataFrame, min_ratio: float = 0.5, top: int = 2) -> DataFrame:
    """base -> technologies found in at least `min_ratio` of its postings."""
    w = Window.partitionBy("base").orderBy(F.desc("n"), "tech")
    return (pairs.where(F.col("n") >= F.col("match_count") * min_ratio)
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .groupBy("base").agg(F.sort_array(F.collect_list(F.struct("rank", "tech"))).alias("r"))
            .select("base", F.col("r.tech").alias("related")))


# ---------------------------------------------------------------- regions

def on_map(df: DataFrame, coords: DataFrame) -> DataFrame:
    """Postings whose location has coordinates (location, lat, lon)."""
    return df.where("location is not null").join(small_side(coords), "location")


def region_summary(mapped: DataFrame, techs: str = "final_techs") -> DataFrame:
    return mapped.groupBy("location").agg(
        F.first("lat").alias("lat"), F.first("lon").alias("lon"),
        F.count(F.lit(1)).alias("job_count"),
        F.sum(F.size(techs)).alias("tech_mentions"))


def busiest_region(regions: DataFrame) -> DataFrame:
    return regions.orderBy(F.desc("job_count"), "location").limit(1)


def region_top_techs(mapped: DataFrame, n: int = 10, min_support: int = 2,
                     techs: str = "final_techs") -> DataFrame:
    counts = tech_frequency(mapped, techs, ["location"]).where(F.col("n") >= min_support)
    return top_techs(counts, n, ["location"])


def nation_top_techs(mapped: DataFrame, n: int = 10, min_support: int = 3,
                     techs: str = "final_techs") -> DataFrame:
    return top_techs(tech_frequency(mapped, techs).where(F.col("n") >= min_support), n)


# ---------------------------------------------------------------- experience levels

def level_slices(df: DataFrame, score: str = "urgency_score") -> DataFrame:
    """Per level: postings, mean score (2 places), share of all known levels in %."""
    known = df.where("experience_level is not null")
    rows = known.groupBy("experience_level").agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("_mean"))
    total = F.sum("n").over(Window.partitionBy())       # five rows
    return rows.select("experience_level", "n", F.round("_mean", 2).alias("mean_score"),
                       F.round(F.col("n") * 100 / total, 1).alias("share_pct"))


def level_top_techs(df: DataFrame, n: int, techs: str = "final_techs") -> DataFrame:
    known = df.where("experience_level is not null")
    return top_techs(tech_frequency(known, techs, ["experience_level"]), n, ["experience_level"])


def level_histogram(df: DataFrame, score: str = "urgency_score") -> DataFrame:
    return (df.where("experience_level is not null").groupBy("experience_level", score)
            .agg(F.count(F.lit(1)).alias("n")))


def level_place(level: Column) -> Column:
    """Position of a level in display order."""
    return F.array_position(F.array(*(F.lit(v) for v in LEVELS)), level)


def level_summary(df: DataFrame, score: str = "urgency_score") -> DataFrame:
    return (level_slices(df, score).withColumn("place", level_place(F.col("experience_level")))
            .select("place", "experience_level", "mean_score", "n").orderBy("place"))
