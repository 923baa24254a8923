"""Text controls for honest training: masking, templates, copies, splits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from gonggo.functions.joins import small_side
from gonggo.functions.ranks import hash_order, rank_in_group
from gonggo.functions.regex import replaced, rx, squeezed
from gonggo.functions.stages import computed
from gonggo.operators import urgency_words as W

# Every phrase the labels were computed from.
LABEL_PATTERNS = (
    r"남은기간\s*[0-9]+\s*일",
    r"접수\s*기간.{0,90}",
    r"마감일\s*[0-9]{4}\.[0-9]{2}\.[0-9]{2}",
    r"마감일\s*상시채용",
    r"시작일\s*[0-9]{4}\.[0-9]{2}\.[0-9]{2}",
    r"모집인원\s*[0-9]+\s*명",
    r"[0-9]{1,3}\s*명\s*(?:내외\s*)?(?:모집|채용|선발)",
    r"다수\s*(?:모집|채용|선발)",
    r"급구|긴급\s*채용|긴급채용|시급히|서둘러",
    r"즉시\s*(?:입사|출근|근무|투입|합류)|바로\s*출근|조속히|즉시\s*채용",
    r"결원|충원|대체\s*인력|공석",
    r"조기\s*마감|마감\s*임박|충원\s*시\s*마감|채용\s*시\s*마감",
    r"합격\s*축하금|입사\s*축하금|사이닝\s*보너스|정착\s*지원금",
    r"상시\s*채용|수시\s*채용|상시\s*모집|연중\s*수시",
    r"채용\s*시\s*마감|채용시까지|채용\s*시\s*까지",
)
MASK = " <MASK> "
LABEL_PATTERN = "|".join(LABEL_PATTERNS)

# Page furniture of the three sites.
JOBKOREA_FURNITURE = (
    r"상세요강\s*접수기간\S*방법\s*기업정보\s*추천공고"
    r"|채용정보에\s*잘못된\s*내용이\s*있을\s*경우\s*문의\s*해주세요\.?"
    r"|지도보기|스크랩|즉시\s*지원|TOP\s*궁금해요"
)
SARAMIN_FURNITURE = (
    r"입사지원\s*서류에\s*허위사실이\s*발견될\s*경우[^.]*?취소될\s*수\s*있습니다\.?"
    r"|지원서\s*및\s*기타\s*제출자료\s*내용에\s*허위사실을\s*포함할\s*경우[^.]*?있습니다\.?"
    r"|모집분야별로\s*마감일이\s*상이할\s*수\s*있으니\s*유의하시길\s*바랍니다\.?"
    r"|학력,?\s*성별,?\s*연령을\s*보지\s*않는\s*블라인드\s*채용입니다\.?"
    r"|채용절차의\s*공정화에\s*관한\s*법률[^.]*?반환하며[^.]*?있습니다\.?"
    r"|채용서류\s*반환\s*청구\s*안내"
    r"|정보\s*수정이\s*필요할\s*경우\s*고객센터[^.]*?문의해\s*주세요\.?"
    r"|정확한\s*상세요강은\s*반드시\s*채용\s*홈페이지에서[^.]*?바랍니다\.?"
    r"|서류전형\s*결과는\s*합격자에\s*한하여\s*개별\s*통보됩니다\.?"
    r"|(?:국가등록장애인|보훈대상자|취업보호대상자)[^.]*?우대(?:합니다|됩니다)\.?"
    r"|이력서양식\s*:\s*사람인\s*온라인\s*이력서"
    r"|접수방법\s*:\s*사람인\s*(?:온라인\s*)?입사지원"
    r"|좋은\s*포지션을\s*추천드립니다\.?"
    r"|필요\s*시\s*레퍼런스\s*체크,?\s*인성검사가\s*진행\s*될\s*수\s*있습니다\.?"
)
BRANDS = r"(?iu)잡코리아|사람인|saramin|jobkorea|원티드|wanted"

PREFIX_CHARS = 600
VARIANTS = ("full", "masked", "clean", "masked+clean")
# A token is a run of two or more word characters.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def mask_text(text: Column, pattern: str = LABEL_PATTERN) -> Column:
    return replaced(F.coalesce(text, F.lit("")), pattern, MASK)


def strip_template(text: Column, source: Column) -> Column:
    """The text without what the site adds to every posting."""
    raw = F.coalesce(text, F.lit(""))
    cut = raw
    for marker in W.TAIL_MARKERS:
        cut = F.substring_index(cut, marker, 1)
    jobkorea = replaced(replaced(cut, W.DISCLAIMER), JOBKOREA_FURNITURE)
    own = (F.when(source == "jobkorea", jobkorea)
           .when(source == "saramin", replaced(raw, SARAMIN_FURNITURE)).otherwise(raw))
    return squeezed(replaced(own, BRANDS))


def apply_variant(text: Column, source: Column, variant: str) -> Column:
    """full, masked, clean or masked+clean; templates go before masking."""
    parts = {p.strip() for p in variant.split("+")}
    unknown = parts - {"full", "masked", "clean"}
    if unknown:
        raise ValueError(f"unknown variant parts: {sorted(unknown)}")
    out = strip_template(text, source) if "clean" in parts else text
    return mask_text(out) if "masked" in parts else out


def overlap_report(df: DataFrame, text: str = "raw_text", source: str = "source") -> DataFrame:
    """How much template removal takes, and how many label phrases go with it."""
    raw = F.coalesce(F.col(text), F.lit(""))
    kept = strip_template(F.col(text), F.col(source))
    seen = computed(df, raw.alias("_raw"), kept.alias("_kept"), keep=())
    seen = seen.select((F.length("_raw") - F.length("_kept")).alias("removed"), "_raw", "_kept") \
        .where("removed > 0")

    def phrases(c):
        return F.regexp_count(c, F.lit(rx(LABEL_PATTERN)))
    return seen.agg(
        F.coalesce(F.sum("removed"), F.lit(0)).cast("long").alias("removed_chars"),
        F.coalesce(F.sum(F.greatest(F.lit(0), phrases(F.col("_raw")) - phrases(F.col("_kept")))),
                   F.lit(0)).cast("long").alias("label_matches_removed"))


def label_tokens(patterns=LABEL_PATTERNS) -> tuple[str, ...]:
    """The Korean literals of the label patterns; words holding one are protected."""
    return tuple(sorted({t for p in patterns for t in re.findall(r"[가-힣]{2,}", p)}))


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def source_stop_words(df: DataFrame, text: str, source: str = "source", min_share: float = 0.5,
                      min_gap: float = 0.4, min_df: int = 10, vocabulary: int = 80_000,
                      max_terms: int = 3000, protected: tuple[str, ...] | None = None) -> DataFrame:
    """(token, gap): words frequent in one source and rare in another.

    Fit on training rows only. Words are counted once per posting; the counts
    per (word, source) are pre-aggregated, and only they are compared.
    """
    protected = label_tokens() if protected is None else protected
    sizes = df.groupBy(source).agg(F.count(F.lit(1)).alias("_rows"))
    n_sources = df.select(source).distinct().agg(F.count(F.lit(1)).alias("c"))
    counts = (df.select(F.col(source), F.explode(F.array_distinct(tokens_of(F.col(text))))
                        .alias("token"))
              .groupBy("token", source).agg(F.count(F.lit(1)).alias("_n")))
    frequent = (counts.groupBy("token").agg(F.sum("_n").alias("_total"))
                .where(F.col("_total") >= min_df)
                .orderBy(F.desc("_total"), "token").limit(vocabulary).select("token"))
    shares = (counts.join(frequent, "token", "left_semi").join(sizes, source)
              .groupBy("token").agg(F.max(F.col("_n") / F.col("_rows")).alias("hi"),
                                    F.min(F.col("_n") / F.col("_rows")).alias("lo"),
                                    F.count(F.lit(1)).alias("_in")))
    # a source without the word has share 0
    gap = F.col("hi") - F.when(F.col("_in") < n_sources.scalar(), 0.0).otherwise(F.col("lo"))
    chosen = shares.select("token", "hi", gap.alias("gap")).where(
        (F.col("hi") >= min_share) & (F.col("gap") >= min_gap))
    for word in protected:
        chosen = chosen.where(~F.contains("token", F.lit(word)))
    return chosen.select("token", "gap").orderBy(F.desc("gap"), "token").limit(max_terms)


# ---------------------------------------------------------------- copies

def normalized(text: Column) -> Column:
    return F.lower(squeezed(F.coalesce(text, F.lit(""))))


def with_copy_keys(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds copy_key (whole text) and near_key (first 600 characters)."""
    out = computed(df, normalized(F.col(text)).alias("_norm"))
    return computed(out, F.md5("_norm").alias("copy_key"),
                    F.md5(F.left("_norm", F.lit(PREFIX_CHARS))).alias("near_key"),
                    keep=tuple(df.columns))


def drop_exact_copies(df: DataFrame, text: str = "raw_text", key: str = "row_id") -> DataFrame:
    """Keeps the first posting (smallest row id) of equal normalised texts.

    Only (key, smallest id) of the texts that occur more than once are looked
    up, found by a pre-aggregated minimum; single texts never leave their task.
    """
    keyed = with_copy_keys(df, text)
    repeated = (keyed.groupBy("copy_key").agg(F.min(key).alias("_first"),
                                              F.count(F.lit(1)).alias("_c"))
                .where("_c > 1").select("copy_key", "_first"))
    return (keyed.join(small_side(repeated), "copy_key", "left")
            .where(F.col("_first").isNull() | (F.col("_first") == F.col(key))).drop("_first"))


def copy_stats(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Rows before and after, removed rows, near-copy groups, rows in groups of two or more.

    Near-copy groups are counted over the rows that stay.
    """
    keyed = with_copy_keys(df, text).select("copy_key", "near_key")
    # equal texts share their first characters, so one near_key per copy_key
    distinct = keyed.groupBy("copy_key").agg(F.count(F.lit(1)).alias("c"),
                                             F.first("near_key").alias("near_key"))
    groups = distinct.groupBy("near_key").agg(F.count(F.lit(1)).alias("kept"),
                                              F.sum("c").alias("rows"))
    return groups.agg(F.sum("rows").alias("rows_before"), F.sum("kept").alias("rows_after"),
                      (F.sum("rows") - F.sum("kept")).alias("exact_dup_rows_removed"),
                      F.count(F.lit(1)).alias("n_groups"),
                      F.sum(F.when(F.col("kept") > 1, F.col("kept")).otherwise(0))
                      .alias("grouped_rows"))


# ---------------------------------------------------------------- strata and splits

def absorb_rare(df: DataFrame, label: str, source: str = "source", least: int = 5) -> DataFrame:
    """Adds stratum (source__label); one with fewer than `least` rows joins the
    largest stratum of its source, or of all when its source has none."""
    name = F.concat(F.col(source), F.lit("__"), F.col(label).cast("string"))
    counts = df.groupBy(source, name.alias("_own")).agg(F.count(F.lit(1)).alias("_n"))
    big = counts.where(F.col("_n") >= least)
    order = F.struct(F.col("_n"), F.col("_own"))
    per_source = big.groupBy(source).agg(F.max(order).alias("_b")) \
        .select(source, F.col("_b._own").alias("_fallback"))
    overall = big.agg(F.max(order).alias("_b")).select(F.col("_b._own").alias("_g"))
    target = (counts.join(per_source, source, "left")
              .select(source, "_own", F.when(F.col("_n") >= least, F.col("_own"))
                      .otherwise(F.coalesce(F.col("_fallback"), overall.scalar(), F.col("_own")))
                      .alias("stratum")))
    return df.withColumn("_own", name).join(small_side(target), [source, "_own"]).drop("_own")


def group_split(df: DataFrame, group: str = "near_key", stratum: str = "stratum",
                folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds split: train (64 %), val (16 %), test (20 %). A group is never divided.

    A group takes its most frequent stratum. Groups are ranked by hash inside
    each stratum, exactly and without gathering a stratum in one task; every
    fifth becomes test, and every fifth of the rest val.
    """
    votes = df.groupBy(group, stratum).agg(F.count(F.lit(1)).alias("_n"))
    owner = (votes.groupBy(group).agg(F.max(F.struct("_n", stratum)).alias("_m"))
             .select(group, F.col(f"_m.{stratum}").alias("_s"))
             .withColumn("_h", hash_order(seed, group)))
    placed = rank_in_group(owner, ["_s"], "_h", group, out="_r")
    turn = F.pmod(F.col("_r") - 1, F.lit(folds * folds))
    split = (F.when(turn % folds == 0, "test")
             .when(F.floor(turn / folds) == turn % folds, "val")
             .otherwise("train"))
    return df.join(placed.select(group, split.alias("split")), group)


def shared_groups(df: DataFrame, group: str = "near_key") -> DataFrame:
    """Number of groups found in more than one part; must be 0."""
    return (df.select(group, "split").distinct().groupBy(group)
            .agg(F.count(F.lit(1)).alias("c")).where("c > 1")
            .agg(F.count(F.lit(1)).alias("shared_groups")))


def stratified_split(df: DataFrame, stratum: str, test_share: float = 0.2, seed: int = 42,
                     key: str = "row_id") -> DataFrame:
    """Adds split (train/test): the first share of each stratum in hash order is test."""
    order = df.select(key, stratum).withColumn("_h", hash_order(seed, key))
    placed = rank_in_group(order, [stratum], "_h", key, out="_r")
    split = F.when(F.col("_r") <= F.round(F.col("_r_n") * F.lit(test_share)), "test") \
        .otherwise("train")
    return df.join(placed.select(key, split.alias("split")), key)


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Exactly min(n, rows) rows in a repeatable random choice."""
    order = df.select(key, F.lit(0).alias("_all")).withColumn("_h", hash_order(seed, key))
    placed = rank_in_group(order, ["_all"], "_h", key, out="_r")
    return df.join(placed.where(F.col("_r") <= n).select(key), key, "left_semi")
