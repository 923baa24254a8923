"""Which postings can be recommended on a given day."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Observation, functions as F

from gonggo.functions.dates import date_in
from gonggo.functions.nulls import blank_to_null
from gonggo.functions.regex import every, first, found
from gonggo.functions.stages import computed
from gonggo.operators import urgency, urgency_words as W
from gonggo.operators.trends import of_sources
from gonggo.session import cut_lineage

# How a deadline is written.
LABELLED_DATE = r"마감일\s*[:\s]?\s*(20\d\d)\s*[.\-/년]\s*(\d{1,2})\s*[.\-/월]\s*(\d{1,2})"
ANY_DATE = r"(20\d\d)\s*[.\-/년]\s*(\d{1,2})\s*[.\-/월]\s*(\d{1,2})"
STATUSES = ("open", "closed", "rolling", "unknown")
META = ("title", "company", "location", "experience_level")


def _latest(text: Column, pattern: str) -> Column:
    return F.array_max(F.transform(every(text, pattern), lambda m: date_in(m, pattern)))


def with_deadline(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds deadline and rolling, read from the whole text.

    The latest labelled date wins. Otherwise, unless hiring is open-ended, the
    latest date of the first application period counts.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    seen = computed(
        df, urgency.is_always_open(raw).alias("_always"), _latest(raw, LABELLED_DATE).alias("_label"),
        first(raw, W.PERIOD, 1).alias("_period"), found(raw, W.ROLLING).alias("_phrase"))
    seen = computed(seen, F.when(~F.col("_always"), _latest(F.col("_period"), ANY_DATE))
                    .alias("_in_period"))
    by_period = F.col("_label").isNull() & F.col("_in_period").isNotNull()
    phrase = F.when(by_period, found(F.col("_period"), W.ROLLING)).otherwise(F.col("_phrase"))
    return computed(seen, F.coalesce("_label", "_in_period").alias("deadline"),
                    (phrase | F.col("_always")).alias("rolling"), keep=tuple(df.columns))


def status_of(deadline: Column, rolling: Column, as_of: Column) -> Column:
    """A date decides before the rolling flag; unknown is not open."""
    return (F.when(deadline >= as_of, "open").when(deadline < as_of, "closed")
            .when(rolling, "rolling").otherwise("unknown"))


def day(as_of) -> Column:
    return F.lit(datetime.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of)


def fill_from_backfill(df: DataFrame, backfill: DataFrame | None) -> DataFrame:
    """Blank saramin fields filled from the side table (job_id unique, status ok).

    Adds bf_deadline and merged (a title or company came from the side table).
    """
    cleaned = df
    for c in META:
        cleaned = cleaned.withColumn(c, blank_to_null(F.col(c)))
    if backfill is None:
        return cleaned.select("*", F.lit(None).cast("date").alias("bf_deadline"),
                              F.lit(False).alias("merged"))
    side = backfill.where(F.col("status") == "ok").select(
        "job_id", F.lit("saramin").alias("source"),
        *(blank_to_null(F.col(c)).alias("bf_" + c) for c in META),
        F.try_to_date("deadline", "yyyy-M-d").alias("bf_deadline"))
    joined = cleaned.join(side, ["source", "job_id"], "left")
    merged = F.coalesce((F.col("title").isNull() & F.col("bf_title").isNotNull())
                        | (F.col("company").isNull() & F.col("bf_company").isNotNull()), F.lit(False))
    filled = {c: F.coalesce(F.col(c), F.col("bf_" + c)).alias(c) for c in META}
    return joined.select(*(filled.get(c, F.col(c)) for c in df.columns),
                         "bf_deadline", merged.alias("merged"))


def recommendation_pool(df: DataFrame, as_of, backfill: DataFrame | None = None,
                        only_open: bool = False, require_techs: bool = False,
                        sources=None, seen: Observation | None = None) -> DataFrame:
    """Postings with a title and a company, with deadline and status on `as_of`.

    `df` holds techs and skills_extra. The status is computed for the day
    asked, never stored with the postings. `seen` observes, in the pass that makes the pool, how many
    postings there were (rows), the side table named (merged), and still have no title or company (unnamed).
    """
    filled = with_deadline(fill_from_backfill(of_sources(df, sources), backfill))
    if seen is not None:
        nameless = F.col("title").isNull() | F.col("company").isNull()
        filled = filled.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("merged").alias("merged"),
                                F.count_if(nameless).alias("unnamed"))
    filled = filled.where("title is not null and company is not null")
    dated = F.col("bf_deadline").isNotNull()
    pool = filled.select(
        "row_id", "job_id", "source", *META, "techs", "skills_extra",
        F.coalesce("bf_deadline", "deadline").alias("deadline"),
        F.when(dated, False).otherwise(F.col("rolling")).alias("rolling"),
        "raw_text", "merged")
    pool = pool.withColumn("status", status_of(F.col("deadline"), F.col("rolling"), day(as_of)))
    if require_techs:
        pool = pool.where(F.size("techs") > 0)
    if only_open:
        pool = pool.where(F.col("status").isin("open", "rolling"))
    return pool


NO_BACKFILL = "no backfill: postings without title and company are left out"


def guarded_pool(df: DataFrame, as_of, backfill: DataFrame | None = None, **options) -> tuple[DataFrame, dict]:
    """The pool as a written stage, and what was observed while it was made: rows, merged, unnamed, warning.

    Without a side table the warning says what that leaves out. One that fills nothing is an error, since
    the pool would be silently short. No pass is made but the one that writes the pool.
    """
    seen = Observation()
    pool = cut_lineage(recommendation_pool(df, as_of, backfill, seen=seen, **options))
    figures = {k: int(v) for k, v in seen.get.items()}
    if backfill is not None and figures["rows"] and not figures["merged"]:
        raise ValueError("the backfill filled no posting")
    return pool, figures | {"warning": NO_BACKFILL if backfill is None else None}


def pool_report(pool: DataFrame) -> DataFrame:
    """Per source and in total: postings by status and gaps in what matching needs."""
    def count_of(condition):
        return F.sum(condition.cast("int"))
    return pool.rollup("source").agg(
        F.count(F.lit(1)).alias("n"),
        *(count_of(F.col("status") == s).alias(s) for s in STATUSES),
        count_of(F.size("techs") == 0).alias("no_techs"),
        count_of((F.size("techs") == 0) & (F.size("skills_extra") == 0)).alias("no_skills"),
        count_of(F.col("location").isNull()).alias("no_location"),
        count_of(F.col("experience_level").isNull()).alias("no_level"))


def duplicate_keys(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier (source, job_id). They are reported, not removed."""
    return (df.groupBy("source", "job_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
            .agg(F.count(F.lit(1)).alias("duplicate_keys"),
                 F.coalesce(F.sum("c"), F.lit(0)).alias("rows_in_them"),
                 F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeats")))


# ---------------------------------------------------------------- share still alive

# Codes of the report: where the closing day was found, and what it says.
SHAPE_A, SHAPE_B = "block", "period"
SHAPE_B_OPEN, SHAPE_B_FAILED = "period_undated_open", "period_undated"
SHAPE_OPEN_ONLY, SHAPE_NONE = "open_only", "none"
ALIVE_DATED, ALIVE_OPEN, GONE, UNDECIDED = "alive_dated", "alive_open", "gone", "undecided"


def deadline_shape(df: DataFrame, as_of, anchored: bool = True) -> DataFrame:
    """Adds end_date, always_open, shape and alive_class for the given day.

    With anchored=False the open-ended phrase is looked for anywhere in the
    body, which also finds other companies' postings.
    """
    seen = urgency.with_window(urgency.with_body(df))
    body = F.col("body")
    phrase = urgency.is_always_open(body) if anchored else found(body, W.ALWAYS_OPEN)
    dated = F.col("window_days").isNotNull()
    seen = computed(seen, (~dated & phrase).alias("always_open"))
    shape = (F.when(F.col("window_by_block"), SHAPE_A).when(dated, SHAPE_B)
             .when(F.col("has_period") & F.col("always_open"), SHAPE_B_OPEN)
             .when(F.col("has_period"), SHAPE_B_FAILED)
             .when(F.col("always_open"), SHAPE_OPEN_ONLY).otherwise(SHAPE_NONE))
    end, today = F.col("window_end"), day(as_of)
    kind = (F.when(F.col("always_open"), ALIVE_OPEN).when(end.isNull(), UNDECIDED)
            .when(end >= today, ALIVE_DATED).otherwise(GONE))
    return seen.select(*df.columns, end.alias("end_date"), "rolling", "always_open",
                       shape.alias("shape"), kind.alias("alive_class"),
                       (F.col("rolling") & (end >= today)).alias("rolling_but_dated"))


def alive_ratio(shaped: DataFrame) -> DataFrame:
    """Class counts and shares per source and overall (source NULL)."""
    def count_of(label):
        return F.sum((F.col("alive_class") == label).cast("int"))
    return shaped.rollup("source").agg(
        F.count(F.lit(1)).alias("n"), count_of(ALIVE_DATED).alias("alive_dated"),
        count_of(ALIVE_OPEN).alias("alive_open"), count_of(GONE).alias("gone"),
        count_of(UNDECIDED).alias("undecided"),
        F.sum(F.coalesce("rolling_but_dated", F.lit(False)).cast("int")).alias("rolling_but_dated")
    ).withColumn("alive_pct", F.round((F.col("alive_dated") + F.col("alive_open")) * 100
                                      / F.col("n"), 1))


def shape_counts(shaped: DataFrame) -> DataFrame:
    return shaped.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- rarity of a skill

def tech_idf(df: DataFrame, min_df: int = 5, include_extra: bool = False) -> DataFrame:
    """(tech, df, idf = ln(rows / df)) over all rows, also those without skills.

    Kept as a decimal, so sums of it do not depend on the order of adding.
    """
    names = F.array_union("techs", "skills_extra") if include_extra else F.array_distinct("techs")
    rows = df.agg(F.count(F.lit(1)).alias("c"))
    return (df.select(F.explode(names).alias("tech")).groupBy("tech")
            .agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
            .select("tech", "df", F.log(rows.scalar() / F.col("df")).cast("decimal(18,12)").alias("idf")))
