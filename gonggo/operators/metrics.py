"""Figures for ordinal labels 1..5, each computed in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gonggo.operators.urgency import fallback_level

CLASSES = (1, 2, 3, 4, 5)


def evaluate(df: DataFrame, truth: str = "y", predicted: str = "p",
             by: tuple[str, ...] = ()) -> DataFrame:
    """n, qwk, mae, off_by_1, macro_f1, accuracy per group.

    Quadratic kappa needs only sums: with y truth and p prediction,
    qwk = 1 - sum (y-p)^2 / (sum y^2 + sum p^2 - 2 sum y sum p / n).
    NULL when both are one constant. Macro F1 is over the classes present.
    """
    y, p = F.col(truth).cast("long"), F.col(predicted).cast("long")
    gap = F.abs(y - p)

    def total(condition: Column) -> Column:
        return F.sum(condition.cast("int"))
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(gap * gap).alias("_dd"), F.sum(gap).alias("_d"),
        F.sum(y * y).alias("_yy"), F.sum(p * p).alias("_pp"), F.sum(y).alias("_y"),
        F.sum(p).alias("_p"), total(gap <= 1).alias("_near"), total(gap == 0).alias("_same"),
        *(x for c in CLASSES for x in (
            total((y == c) & (p == c)).alias(f"_tp{c}"),
            (total(y == c) + total(p == c)).alias(f"_all{c}"))))
    n = F.col("n")
    spread = F.col("_yy") + F.col("_pp") - 2 * F.col("_y") * F.col("_p") / n
    f1 = F.filter(F.array(*(
        F.when(F.col(f"_all{c}") > 0, 2 * F.col(f"_tp{c}") / F.col(f"_all{c}")) for c in CLASSES)),
        lambda x: x.isNotNull())
    return sums.where("n > 0").select(
        *by, "n", (1 - F.try_divide(F.col("_dd"), spread)).alias("qwk"),
        (F.col("_d") / n).alias("mae"), (F.col("_near") / n).alias("off_by_1"),
        (F.aggregate(f1, F.lit(0.0), lambda a, x: a + x) / F.size(f1)).alias("macro_f1"),
        (F.col("_same") / n).alias("accuracy"))


def rounded(figures: DataFrame, places: int = 6) -> DataFrame:
    return figures.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c)
                            for c, t in figures.dtypes))


def confusion(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """Rows: truth; columns pred_1 … pred_5."""
    return df.groupBy(F.col(truth).alias("truth")).agg(*(
        F.sum((F.col(predicted) == c).cast("int")).alias(f"pred_{c}") for c in CLASSES))


def class_report(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where undefined."""
    marks = df.groupBy(F.col(truth).alias("_y"), F.col(predicted).alias("_p")) \
        .agg(F.count(F.lit(1)).alias("_n"))
    per = marks.select("_n", "_y", "_p", F.explode(F.array(*(F.lit(c) for c in CLASSES)))
                       .alias("label"))

    def total(condition):
        return F.sum(F.when(condition, F.col("_n")).otherwise(0))
    hit, said, real = F.col("tp"), F.col("said"), F.col("support")
    return (per.groupBy("label").agg(
        total((F.col("_y") == F.col("label")) & (F.col("_p") == F.col("label"))).alias("tp"),
        total(F.col("_p") == F.col("label")).alias("said"),
        total(F.col("_y") == F.col("label")).alias("support"))
        .select("label", F.when(said > 0, hit / said).otherwise(0.0).alias("precision"),
                F.when(real > 0, hit / real).otherwise(0.0).alias("recall"),
                F.when(said + real > 0, 2 * hit / (said + real)).otherwise(0.0).alias("f1"),
                "support"))


def select_best(figures: DataFrame, name: str = "model") -> DataFrame:
    """The row with the highest qwk; equal ones in name order."""
    return figures.orderBy(F.desc_nulls_last("qwk"), name).limit(1)


def expected_level(probabilities: Column) -> Column:
    """Level 1..5 from class probabilities: expected value, halves to even."""
    weighted = F.transform(probabilities, lambda p, i: p * i)
    value = F.rint(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x))
    return F.greatest(F.lit(0), F.least(value.cast("int"), F.lit(4))) + 1


def top_level(probabilities: Column) -> Column:
    return F.array_position(probabilities, F.array_max(probabilities)).cast("int")


# ---------------------------------------------------------------- label studies

def constant_of(df: DataFrame, label: str = "y") -> int:
    """Median of the training labels, cut to a whole level."""
    value = df.agg(F.percentile(label, 0.5)).first()[0]
    return int(value)


def fallback_grid(df: DataFrame, bases=(1, 2, 3), scales=(0.0, 0.25, 0.5, 0.75, 1.0),
                  label: str = "y", points: str = "add") -> DataFrame:
    """Figures of every (base, scale) over one histogram of (label, points)."""
    counts = df.groupBy(label, points).agg(F.count(F.lit(1)).alias("w"))
    grid = F.array(*(F.struct(F.lit(b).alias("base"), F.lit(float(s)).alias("scale"))
                     for b in bases for s in scales))
    cells = counts.select(label, points, "w", F.inline(grid))
    predicted = cells.withColumn("p", fallback_level(F.col(points), F.col("base"), F.col("scale")))
    return evaluate_weighted(predicted, label, "p", "w", ("base", "scale"))


def evaluate_weighted(df: DataFrame, truth: str, predicted: str, weight: str,
                      by: tuple[str, ...]) -> DataFrame:
    """mae and qwk over rows that stand for `weight` equal ones."""
    y, p, w = F.col(truth), F.col(predicted), F.col(weight)
    sums = df.groupBy(*by).agg(
        F.sum(w).alias("n"), F.sum(w * (y - p) * (y - p)).alias("_dd"),
        F.sum(w * F.abs(y - p)).alias("_d"), F.sum(w * y * y).alias("_yy"),
        F.sum(w * p * p).alias("_pp"), F.sum(w * y).alias("_y"), F.sum(w * p).alias("_p"))
    spread = F.col("_yy") + F.col("_pp") - 2 * F.col("_y") * F.col("_p") / F.col("n")
    return sums.select(*by, "n", (1 - F.try_divide(F.col("_dd"), spread)).alias("qwk"),
                       (F.col("_d") / F.col("n")).alias("mae"))


def choose_fallback(grid: DataFrame, base: int = 3, scale: float = 1.0) -> DataFrame:
    """Among cells whose qwk is at least that of (base, scale): least mae, then most qwk."""
    now = grid.where((F.col("base") == base) & (F.col("scale") == scale)).select("qwk")
    return (grid.where(F.col("qwk") >= now.scalar())
            .orderBy("mae", F.desc("qwk"), "base", "scale").limit(1))


def unmeasurable_shift(df: DataFrame, variants, points: str = "add") -> DataFrame:
    """Where fallback parameters put the postings that cannot be measured."""
    counts = df.groupBy(points).agg(F.count(F.lit(1)).alias("w"))
    grid = F.array(*(F.struct(F.lit(b).alias("base"), F.lit(float(s)).alias("scale"))
                     for b, s in variants))
    cells = counts.select(points, "w", F.inline(grid)).withColumn(
        "p", fallback_level(F.col(points), F.col("base"), F.col("scale")))
    levels = [F.sum(F.when(F.col("p") == c, F.col("w")).otherwise(0)).alias(f"level_{c}")
              for c in CLASSES]
    return (cells.groupBy("base", "scale").agg(
        F.sum("w").alias("n"), F.sum(F.when(F.col(points) == 0, F.col("w")).otherwise(0))
        .alias("zero_evidence"), *levels)
        .select("*", F.round(F.col("zero_evidence") * 100 / F.col("n"), 1).alias("zero_pct"),
                F.round(F.greatest(*(F.col(f"level_{c}") for c in CLASSES)) * 100 / F.col("n"), 1)
                .alias("modal_pct")))


def gain_over_constant(figures: DataFrame, constant: DataFrame, keys: list[str]) -> DataFrame:
    """mae gain in % over each label's own constant."""
    base = constant.select(*keys, F.col("mae").alias("base_mae"))
    return figures.join(base, keys).withColumn(
        "mae_gain_pct", F.try_divide((F.col("base_mae") - F.col("mae")) * 100, F.col("base_mae")))


def merge_history(kept: DataFrame, fresh: DataFrame, label: str = "label") -> DataFrame:
    """Earlier result rows whose label was not measured again, plus the new ones."""
    old = kept.join(fresh.select(label).distinct(), label, "left_anti")
    return old.unionByName(fresh)


def relative_drop(full: Column, masked: Column) -> Column:
    return F.try_divide((full - masked) * 100, full)


def drop_band(drop: Column) -> Column:
    return F.when(drop > 30, "severe").when(drop > 10, "considerable").otherwise("limited")


def level_shares(df: DataFrame, *columns: str) -> DataFrame:
    """Share in % of each level in each of several label columns."""
    stacked = df.select(F.inline(F.array(*(
        F.struct(F.lit(c).alias("which"), F.col(c).alias("level")) for c in columns))))
    counts = stacked.groupBy("which", "level").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share_pct", F.round(
        F.col("n") * 100 / F.sum("n").over(Window.partitionBy("which")), 1))
