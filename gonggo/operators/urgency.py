"""The explainable urgency rule as a chain of column stages.

Every stage is a projection, so labelling a corpus is one scan with no
shuffle. What later stages read many times (cleaned body, matched windows) is
made by `computed`, so no regular expression is copied into its readers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from gonggo.functions.dates import date_in
from gonggo.functions.joins import small_side
from gonggo.functions.nulls import kept
from gonggo.functions.regex import every, first, found, replaced, rx
from gonggo.functions.stages import computed
from gonggo.operators import urgency_words as W


@dataclass(frozen=True)
class RulePack:
    """What differs between rule versions."""
    version: str
    days_left_first: bool        # score days remaining when the page shows them
    reads_start_end: bool        # understand "start … deadline …" blocks
    anchored_always_open: bool   # look for open-ended hiring only in its fields
    pressure_once: bool          # one phrase must not score as rolling and early close
    drops_applicant_stats: bool
    fallback_base: int
    fallback_scale: float


V2 = RulePack("v2", True, False, False, False, False, 3, 1.0)
V5 = RulePack("v5", False, True, True, True, True, 2, 0.25)
PACKS = {"v2": V2, "v5": V5}


# ---------------------------------------------------------------- pieces

def clean_body(raw: Column, source: Column, pack: RulePack = V5) -> Column:
    """The part of a page that is about the posting itself."""
    text = F.coalesce(raw, F.lit(""))
    body = text
    for marker in W.TAIL_MARKERS:
        body = F.substring_index(body, marker, 1)
    body = replaced(body, W.DISCLAIMER)
    if pack.drops_applicant_stats:
        body = replaced(body, W.APPLICANT_STATS)
    return F.when(source == "jobkorea", body).otherwise(text)


def says_always_open(window: Column) -> Column:
    return found(window, W.ALWAYS_OPEN) & ~found(window, W.ALWAYS_OPEN_DENIED)


def is_always_open(body: Column) -> Column:
    """Open-ended hiring stated in a field or the title of this posting."""
    windows = F.concat(*(every(body, field, 1, quick=True) for field in W.ALWAYS_OPEN_FIELDS))
    title = F.regexp_extract(F.substring(body, 1, W.TITLE_CHARS), rx(W.TITLE_END), 1)
    return F.coalesce(F.exists(windows, says_always_open) | says_always_open(title),
                      F.lit(False))


def days_between(start: Column, end: Column) -> Column:
    """Window length, NULL outside 0..400."""
    days = F.datediff(end, start)
    return F.when(days.between(0, W.MAX_WINDOW_DAYS), days)


def is_measurable(raw: Column) -> Column:
    return found(F.coalesce(raw, F.lit("")), W.META_SECTION, quick=True)


def to_level(evidence: Column) -> Column:
    level = F.when(evidence <= W.LEVEL_LIMITS[0][0], W.LEVEL_LIMITS[0][1])
    for limit, value in W.LEVEL_LIMITS[1:]:
        level = level.when(evidence <= limit, value)
    return level.otherwise(W.TOP_LEVEL)


def fallback_level(add: Column, base, scale) -> Column:
    """clip(base + add x scale, 1, 5), halves rounded up."""
    base = base if isinstance(base, Column) else F.lit(base)
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    level = F.floor(base + add * scale + F.lit(0.5)).cast("int")
    return F.greatest(F.lit(1), F.least(level, F.lit(5)))


def vocabulary_hits(raw: Column) -> Column:
    text = F.coalesce(raw, F.lit(""))
    return kept(*(F.when(found(text, pattern, quick=True), F.lit(name))
                  for name, pattern, _ in W.VOCABULARY))


def vocabulary_points(hits: Column) -> Column:
    """Points of the named hits; the first five names count two each."""
    return sum((F.when(F.array_contains(hits, name), points).otherwise(0)
                for name, _, points in W.VOCABULARY), F.lit(0))


def level_name(level: Column) -> Column:
    names = F.create_map(*(x for k, v in W.LEVEL_NAMES.items() for x in (F.lit(k), F.lit(v))))
    return names[level]


# ---------------------------------------------------------------- stages

def with_body(df: DataFrame, text="raw_text", source="source", pack: RulePack = V5) -> DataFrame:
    return computed(df, clean_body(F.col(text), F.col(source), pack).alias("body"))


def with_window(df: DataFrame, pack: RulePack = V5) -> DataFrame:
    """Adds window_days, rolling and the window's end to a table with `body`.

    A valid start/deadline block wins, with the rolling phrase looked for in
    the block and the 40 characters after it. Otherwise the first application
    period is read: 90 characters, two dates.
    """
    body = F.col("body")
    block = first(body, W.START_END + r"(?s:.{0,%d})" % W.ROLLING_REACH, 0, quick=True) \
        if pack.reads_start_end else F.lit(None).cast("string")
    out = computed(df, first(body, W.PERIOD, 1, quick=True).alias("_period"), block.alias("_block"),
                   found(body, r"접수\s*기간", quick=True).alias("has_period"))
    block, period = F.col("_block"), F.col("_period")
    dates = F.transform(F.slice(every(period, W.DATE), 1, 2), lambda m: date_in(m, W.DATE))
    out = computed(out, date_in(block, W.START_END, (1, 2, 3)).alias("_a_start"),
                   date_in(block, W.START_END, (4, 5, 6)).alias("_a_end"), dates.alias("_dates"))
    out = computed(
        out, days_between(F.col("_a_start"), F.col("_a_end")).alias("_a_days"),
        days_between(F.get("_dates", F.lit(0)), F.get("_dates", F.lit(1))).alias("_b_days"))
    by_block = F.col("_a_days").isNotNull()
    return computed(
        out, F.coalesce("_a_days", "_b_days").alias("window_days"),
        found(F.when(by_block, block).otherwise(period), W.ROLLING).alias("rolling"),
        F.when(by_block, F.col("_a_end"))
        .when(F.col("_b_days").isNotNull(), F.get("_dates", F.lit(1))).alias("window_end"),
        by_block.alias("window_by_block"), keep=(*df.columns, "has_period"))


def with_signals(df: DataFrame, text="raw_text", pack: RulePack = V5) -> DataFrame:
    """Adds one column per signal. Needs body, window_days and rolling."""
    body = F.col("body")
    counted = F.coalesce(first(body, W.HEADCOUNT, quick=True), first(body, W.HEADCOUNT_LOOSE, quick=True))
    open_ended = is_always_open(body) if pack.anchored_always_open else found(body, W.ALWAYS_OPEN, quick=True)
    flags = [found(body, pattern, quick=True).alias("is_" + name)
             for name, pattern, _, _ in (*W.FLAG_SIGNALS, W.BONUS_SIGNAL)]
    left = first(F.coalesce(F.col(text), F.lit("")), W.DAYS_LEFT) if pack.days_left_first \
        else F.lit(None).cast("string")
    return computed(
        df, left.try_cast("decimal(38,0)").alias("days_left"),
        counted.try_cast("decimal(38,0)").alias("headcount"),
        found(body, W.MANY, quick=True).alias("is_many"),
        found(body, W.EARLY_CLOSE, quick=True).alias("is_early_close"),
        open_ended.alias("is_always_open"),
        *flags)


def _tier(value: Column, tiers, describe) -> tuple[Column, Column]:
    """(points, reason) by the first upper limit that holds `value`."""
    points = reason = None
    for limit, weight, note in tiers:
        here = value.isNotNull() if limit is None else value <= limit
        label = describe(note)
        points = F.when(here, weight) if points is None else points.when(here, weight)
        reason = F.when(here, label) if reason is None else reason.when(here, label)
    return F.coalesce(points, F.lit(0)), reason


def with_evidence(df: DataFrame, pack: RulePack = V5) -> DataFrame:
    """Adds evidence (points) and signal_reasons (ordered) from the signals."""
    window, rolling = F.col("window_days"), F.col("rolling")
    early = F.col("is_early_close")

    window_points, window_reason = _tier(
        window, W.WINDOW_TIERS,
        lambda note: F.concat(F.lit("접수 "), window.cast("string"), F.lit("일"),
                              F.lit(f"({note})" if note else "")))
    left = F.col("days_left")
    left_points, left_reason = _tier(
        left, W.DAYS_LEFT_TIERS,
        lambda note: F.concat(F.lit("마감 "), left.cast("string"), F.lit("일 전"),
                              F.lit(f"({note})" if note else "")))

    counts_rolling = rolling & ~early if pack.pressure_once else rolling
    counts_open = ~rolling & window.isNull() & F.col("is_always_open")
    end_points = (window_points + F.when(counts_rolling, W.ROLLING_POINTS).otherwise(0)
                  + F.when(counts_open, W.ALWAYS_OPEN_POINTS).otherwise(0))
    end_reasons = [window_reason,
                   F.when(counts_rolling, F.lit(W.ROLLING_REASON)),
                   F.when(counts_open, F.lit(W.ALWAYS_OPEN_REASON))]
    if pack.days_left_first:
        end_points = F.when(left.isNotNull(), left_points).otherwise(end_points)
        end_reasons = [left_reason] + [F.when(left.isNull(), r) for r in end_reasons]

    people = F.col("headcount")
    has_people = F.coalesce(people > 0, F.lit(False))
    many = ~has_people & F.col("is_many")
    size_points, size_reason = F.lit(0), F.lit(None).cast("string")
    for least, weight, note in reversed(W.HEADCOUNT_TIERS):
        here = people >= least
        label = F.concat(F.lit("모집인원 "), people.cast("string"), F.lit("명" + note))
        size_points = F.when(here, weight).otherwise(size_points)
        size_reason = F.when(here, label).otherwise(size_reason)
    size_points = size_points + F.when(many, W.MANY_POINTS).otherwise(0)

    early_reason = F.lit(W.EARLY_CLOSE_REASON)
    if pack.pressure_once:
        early_reason = F.when(rolling, F.lit(W.ROLLING_REASON)).otherwise(early_reason)

    flag_points, flag_reasons = F.lit(0), []
    for name, _, weight, label in W.FLAG_SIGNALS:
        flag_points = flag_points + F.when(F.col("is_" + name), weight).otherwise(0)
        flag_reasons.append(F.when(F.col("is_" + name), F.lit(label)))
    bonus, _, bonus_weight, bonus_label = W.BONUS_SIGNAL
    points = (end_points + size_points + flag_points
              + F.when(early, W.EARLY_CLOSE_POINTS).otherwise(0)
              + F.when(F.col("is_" + bonus), bonus_weight).otherwise(0))
    reasons = kept(*end_reasons, size_reason, F.when(many, F.lit(W.MANY_REASON)),
                   *flag_reasons, F.when(early, early_reason),
                   F.when(F.col("is_" + bonus), F.lit(bonus_label)))
    return computed(df, points.cast("int").alias("evidence"), reasons.alias("signal_reasons"))


def reason_sentence(level: Column, reasons: Column, measurable: Column,
                    pack: RulePack = V5) -> Column:
    head = F.concat(F.lit(W.REASON_HEAD), level_name(level))
    listed = F.concat_ws(W.REASON_JOIN, reasons)
    none = F.size(reasons) == 0
    base_text, base_end = W.REASON_BASE_ONLY[pack.version]
    base = F.concat(head, F.lit(base_text), level.cast("string"), F.lit(base_end)) \
        if base_end else F.concat(head, F.lit(base_text))
    word_text, word_end = W.REASON_VOCABULARY[pack.version]
    return (F.when(~measurable & none, base)
            .when(~measurable, F.concat(head, F.lit(word_text), listed, F.lit(word_end)))
            .when(none, F.concat(head, F.lit(W.REASON_DASH), F.lit(W.REASON_NO_SIGNAL[pack.version])))
            .otherwise(F.concat(head, F.lit(W.REASON_DASH), listed)))


# ---------------------------------------------------------------- whole rule

INNER = ("body", "window_end", "window_by_block", "has_period", "days_left", "headcount",
         "is_many", "is_early_close", "is_always_open", "is_urgent", "is_immediate",
         "is_backfill", "is_bonus", "evidence", "signal_reasons", "vocabulary")


def signal_table(df: DataFrame, text="raw_text", source="source",
                 pack: RulePack = V5) -> DataFrame:
    """`df` plus body, window, signals, evidence."""
    return with_evidence(with_signals(with_window(with_body(df, text, source, pack), pack),
                                      text, pack), pack)


def score_postings(df: DataFrame, text="raw_text", source="source",
                   pack: RulePack = V5, keep_inner: bool = False, known: bool = False) -> DataFrame:
    """Adds the eight result columns of the rule to each posting.

    `known` says that `df` has measurable and vocabulary already, which all rule versions share.

    urgency_score, urgency_reason, evidence_score (NULL when the posting has no
    recruiting section), reasons, measurable, window_days, rolling, rule_version.
    """
    base = df.drop("urgency_score", "urgency_reason")
    scored = signal_table(base, text, source, pack)
    if not known:
        scored = computed(scored, is_measurable(F.col(text)).alias("measurable"),
                          vocabulary_hits(F.col(text)).alias("vocabulary"))
    scored = computed(
        scored,
        F.when(F.col("measurable"), to_level(F.col("evidence")))
        .otherwise(fallback_level(vocabulary_points(F.col("vocabulary")),
                                  pack.fallback_base, pack.fallback_scale))
        .alias("urgency_score"),
        F.when(F.col("measurable"), F.col("signal_reasons"))
        .otherwise(F.col("vocabulary")).alias("reasons"),
        F.when(F.col("measurable"), F.col("evidence")).alias("evidence_score"))
    scored = computed(
        scored,
        reason_sentence(F.col("urgency_score"), F.col("reasons"), F.col("measurable"), pack)
        .alias("urgency_reason"),
        F.lit(pack.version).alias("rule_version"))
    return scored if keep_inner else scored.drop(*INNER)


def structured_features(df: DataFrame, text="raw_text", source="source") -> DataFrame:
    """Eleven doubles per posting, -1 where a number is missing."""
    seen = with_signals(with_window(with_body(df, text, source)), text)
    people = F.col("headcount") > 0
    flag = {"is_urgent_word": "is_urgent", "has_bonus": "is_bonus"}
    values = {
        "window_days": F.coalesce(F.col("window_days").cast("double"), F.lit(-1.0)),
        "window_missing": F.col("window_days").isNull().cast("double"),
        "rolling": F.col("rolling").cast("double"),
        "headcount": F.when(people, F.col("headcount").cast("double")).otherwise(-1.0),
        "headcount_missing": F.when(people, 0.0).otherwise(1.0),
    }
    return seen.select(
        *df.columns,
        *(values.get(n, F.col(flag.get(n, n)).cast("double")).alias("f_" + n)
          for n in W.FEATURE_NAMES))


# ---------------------------------------------------------------- reports

def label_distribution(scored: DataFrame) -> DataFrame:
    """Rows per level for each source and in total (source NULL)."""
    levels = [F.sum(F.when(F.col("urgency_score") == i, 1).otherwise(0)).alias(f"level_{i}")
              for i in range(1, 6)]
    return scored.rollup("source").agg(F.count(F.lit(1)).alias("n"), *levels)


def label_transitions(old: DataFrame, new: DataFrame, top: int | None = None) -> DataFrame:
    """(old level, new level) counts of rows whose level changed.

    Rows are matched by row_id, never by (source, job_id), which is not unique.
    """
    pairs = (old.select("row_id", F.col("urgency_score").alias("old_level"))
             .join(new.select("row_id", F.col("urgency_score").alias("new_level")), "row_id")
             .where("old_level <> new_level")
             .groupBy("old_level", "new_level").agg(F.count(F.lit(1)).alias("n")))
    return pairs.orderBy(F.desc("n"), "old_level", "new_level").limit(top) if top else pairs


def assert_aligned(old: DataFrame, new: DataFrame) -> None:
    """Raise unless both label tables hold the same rows under the same keys."""
    keys = ["row_id", "source", "job_id"]
    joined = old.select(*keys).withColumn("_o", F.lit(1)).join(
        new.select(*keys).withColumn("_n", F.lit(1)), keys, "full_outer")
    off = joined.where("_o is null or _n is null").limit(1).count()
    if off:
        raise ValueError("label versions do not hold the same rows")


def evidence_quantiles(evidence: DataFrame) -> DataFrame:
    """Nearest-rank p50/p75/p90, zero share and maximum per source and in total.

    Works on counts per distinct evidence value, so a source of any size costs
    one small window.
    """
    per_source = evidence.groupBy("source", "evidence").agg(F.count(F.lit(1)).alias("n"))
    overall = (per_source.groupBy("evidence").agg(F.sum("n").alias("n"))
               .select(F.lit(None).cast("string").alias("source"), "evidence", "n"))
    counts = per_source.unionByName(overall)
    w = Window.partitionBy("source").orderBy("evidence")
    ranked = counts.select(
        "source", "evidence", "n",
        F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(Window.partitionBy("source")).alias("total"))

    def quantile(p):
        place = F.least(F.floor(F.col("total") * F.lit(p)), F.col("total") - 1)
        return F.min(F.when(F.col("upto") > place, F.col("evidence")))
    return ranked.groupBy("source").agg(
        F.max("total").alias("n"),
        F.sum(F.when(F.col("evidence") == 0, F.col("n")).otherwise(0)).alias("zero_rows"),
        quantile(0.50).alias("p50"), quantile(0.75).alias("p75"), quantile(0.90).alias("p90"),
        F.max("evidence").alias("max_evidence"))


# Evidence buckets of the report.
BUCKETS = ((0, 0), (1, 10), (11, 20), (21, 30), (31, 40), (41, 55), (56, 70), (71, 200))


def evidence_buckets(evidence: DataFrame) -> DataFrame:
    counts = evidence.agg(*(
        F.sum(F.col("evidence").between(low, high).cast("int")).alias(f"{low}-{high}")
        for low, high in BUCKETS))
    return counts.select(F.inline(F.array(*(
        F.struct(F.lit(c).alias("bucket"), F.col(c).alias("n")) for c in counts.columns)))) \
        .where("n > 0")


def reference_stats(scored: DataFrame) -> DataFrame:
    """One row per part: each source, all rows, the measurable rows."""
    levels = [F.sum(F.when(F.col("urgency_score") == i, 1).otherwise(0)).alias(f"level_{i}")
              for i in range(1, 6)]
    n = F.count(F.lit(1)).alias("n")
    by_source = scored.groupBy(F.concat(F.lit("source:"), "source").alias("part")).agg(n, *levels)
    split = scored.select(
        F.explode(F.when(F.col("measurable"), F.array(F.lit("overall"), F.lit("measurable")))
                  .otherwise(F.array(F.lit("overall")))).alias("part"), "urgency_score")
    return by_source.unionByName(split.groupBy("part").agg(n, *levels))


def window_percentiles(scored: DataFrame) -> DataFrame:
    """Linear percentiles of the window length, cut to whole days."""
    points = (10, 25, 50, 75, 90)
    p = F.percentile("window_days", F.array(*(F.lit(x / 100) for x in points)))
    return (scored.where("measurable and window_days is not null")
            .agg(p.alias("p"), F.count(F.lit(1)).alias("window_n"))
            .select("window_n", *(F.col("p")[i].cast("int").alias(f"p{x}")
                                  for i, x in enumerate(points))))


def score_percentiles(scored: DataFrame) -> DataFrame:
    """For each source (NULL = all): share of postings at or below each level."""
    counts = label_distribution(scored)
    levels = F.array(*(F.struct(F.lit(i).alias("level"), F.col(f"level_{i}").alias("k"))
                       for i in range(1, 6)))
    w = Window.partitionBy("source").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return (counts.select("source", "n", F.inline(levels))
            .select("source", F.col("level"), (F.sum("k").over(w) * 100 / F.col("n"))
                    .alias("percentile")))


def with_percentile(scored: DataFrame, percentiles: DataFrame) -> DataFrame:
    """Each posting's percentile in its source; sources without figures use the total."""
    own = percentiles.where("source is not null").select(
        "source", F.col("level").alias("urgency_score"), F.col("percentile").alias("_own"))
    total = percentiles.where("source is null").select(
        F.col("level").alias("urgency_score"), F.col("percentile").alias("_all"))
    return (scored.join(small_side(own), ["source", "urgency_score"], "left")
            .join(small_side(total), "urgency_score", "left")
            .withColumn("percentile", F.coalesce("_own", "_all")).drop("_own", "_all"))


def explanation_kind(scored: DataFrame, has_deadline: Column) -> DataFrame:
    """Why a score should be read with care, if it should."""
    kind = (F.when(~F.col("measurable"), "unmeasurable")
            .when(F.col("window_days").isNull() & has_deadline, "no_window")
            .when(F.size("reasons") == 0, "no_signal"))
    return scored.withColumn("caution", kind)


def second_opinion(scored: DataFrame, predicted: Column) -> DataFrame:
    """The rule's score beside a model's; a model counts only in its scope."""
    gap = F.abs(predicted - F.col("urgency_score"))
    return scored.select(
        "*", predicted.alias("model_score"), F.col("measurable").alias("in_scope"),
        F.when(~F.col("measurable"), "out_of_scope").when(gap == 0, "agrees")
        .otherwise(F.concat(F.lit("differs_by_"), gap.cast("string"))).alias("opinion"))
