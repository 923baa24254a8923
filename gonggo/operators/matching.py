"""Matching résumés to postings by weighted skill overlap.

All queries are answered in one plan. The pool is reduced to profiles first (equal skill sets are scored
once, each keeping its k first postings). Skills are taken heaviest first: what a profile can still reach
is bounded by the query's lighter skills, and pairs that cannot reach the query's k-th score are left out
before they are scored. Only each partition's best k per query travel on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gonggo.functions.joins import small_side, spread
from gonggo.functions.regex import every
from gonggo.functions.stages import computed
from gonggo.operators.pool import recommendation_pool, tech_idf
from gonggo.operators.techs import expand_hypernyms, extract_techs
from gonggo.operators.trends import cooccurrence, related_map
from gonggo.session import LOOKUP_BYTES, cut_lineage, measured_bytes

FILTERS = ("experience_level", "location")
WORD = r"[A-Za-z가-힣0-9]+"


def _or_one(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(1.0)


def _root(x: Column) -> Column:
    return F.sqrt(x.cast("double"))


def _ratio(x: Column, y: Column) -> Column:
    return F.when(y > 0, x.cast("double") / y.cast("double")).otherwise(0.0)


# A scorer is a column over: hit, hit_sq, hit_n (sums of weight, weight squared
# and count over shared skills) and the same for the posting (job) and the
# query (mine).
Scorer = Callable[[], Column]
SCORERS: dict[str, Scorer] = {
    "raw_idf": lambda: F.col("hit").cast("double"),
    "length_norm": lambda: F.col("hit").cast("double") / _or_one(_root(F.col("job"))),
    "jaccard": lambda: _ratio(F.col("hit_n"), F.col("mine_n") + F.col("job_n") - F.col("hit_n")),
    "cosine": lambda: F.col("hit_sq").cast("double")
    / (_or_one(_root(F.col("mine_sq"))) * _or_one(_root(F.col("job_sq")))),
    "per_skill_count": lambda: _ratio(F.col("hit"), F.col("job_n")),
}
# The schemes of the evaluation's own baseline matcher; there jaccard is weighted.
SCHEMES: dict[str, Scorer] = {
    "none": SCORERS["raw_idf"],
    "sqrt": SCORERS["length_norm"],
    "linear": lambda: F.col("hit").cast("double") / _or_one(F.col("job").cast("double")),
    "count": SCORERS["per_skill_count"],
    "cosine": SCORERS["cosine"],
    "jaccard": lambda: _ratio(F.col("hit"), F.col("job") + F.col("mine") - F.col("hit")),
}
DEFAULT_SCORER = "length_norm"


def scorer(name: str, registry: dict[str, Scorer] = SCORERS) -> Column:
    if name not in registry:
        raise ValueError(f"unknown score mode {name!r}; known: {', '.join(registry)}")
    return F.round(registry[name](), 12)


# Scorers that look at numbers of skills alone.
_BY_COUNT = (SCORERS["jaccard"],)
# About so many profiles are scored first, for scores that the rest must reach.
SEED_PROFILES = 2000
_SUM, _SQUARES = "decimal(28,12)", "decimal(38,24)"


def _weights(df: DataFrame, key: str, idf: DataFrame, prefix: str,
             carried: list[str]) -> DataFrame:
    """Per row: weighted skills and the sums of their weights (0 when unknown)."""
    w = F.coalesce("idf", F.lit(0).cast("decimal(18,12)"))
    rows = df.select(key, *carried, F.explode("techs").alias("tech")).join(
        idf, "tech", "left").select(key, *carried, "tech", w.alias("w"), F.col("idf").isNotNull().alias("known"))
    return rows.groupBy(key).agg(
        *(F.first(c).alias(c) for c in carried),
        F.collect_list(F.struct("w", "tech", "known", _squared(F.col("w")).alias("sq"),
                                (F.col("w") * 10**12).cast("long").alias("units"))).alias(prefix + "_skills"),
        F.sum("w").alias(prefix), F.sum(_squared(F.col("w"))).alias(prefix + "_sq"),
        F.count(F.lit(1)).alias(prefix + "_n"))


def _squared(w: Column) -> Column:
    return (w * w).cast(_SQUARES)


def _members(pool: DataFrame, entity: str, filters: list[str]) -> DataFrame:
    """(profile, entity, row, techs, …): a profile is a skill set with the filtered fields; `row` is the
    entity's first pool row of that profile."""
    techs = F.sort_array(F.array_distinct("techs"))
    key = F.md5(F.concat_ws("\x1f", F.concat_ws("\x1e", techs), *(F.coalesce(F.col(f), F.lit("\x1d")) for f in filters)))
    row = "row_id" if "row_id" in pool.columns else entity
    return (pool.where(F.size("techs") > 0)
            .select(key.alias("profile"), F.col(entity).alias("entity"), F.col(row).alias("row"), techs.alias("techs"), *filters))


def _profiles(members: DataFrame, k: int, carried: list[str]) -> DataFrame:
    """Profiles with their k smallest entities.

    Where an entity has one profile only, no further one can reach a top k:
    all entities of a profile score the same.
    """
    nearest = Window.partitionBy("profile").orderBy("entity")
    kept = members.withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k)
    return _spread_profiles(kept.groupBy("profile").agg(
        *(F.first(c).alias(c) for c in carried), F.min("entity").alias("entity"),
        F.sort_array(F.collect_list("entity")).alias("entities")))


def _spread_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles over all shuffle partitions; under a new key, since an exchange
    on the key they are already grouped by would be optimised away."""
    return spread(profiles.withColumn("profile", F.upper("profile")), "profile")


def _doubled(*names: str) -> dict[str, Column]:
    """The exact sums under e_<name>, and as doubles, for bounds, under their own names."""
    return {"e_" + n: F.col(n) for n in names} | {n: F.col(n).cast("double") for n in names}


def _summed(profiles: DataFrame, idf: DataFrame, by_count: bool) -> DataFrame:
    """`profiles` with the sums of their weights, as a written stage."""
    carried = [c for c in profiles.columns if c != "profile"]
    if by_count:
        zero = F.lit(0)
        out = profiles.select("*", zero.cast(_SUM).alias("job"), zero.cast(_SQUARES).alias("job_sq"), F.size("techs").cast("long").alias("job_n"))
    else:
        out = _weights(profiles, "profile", idf, "job", carried).drop("job_skills")
    return cut_lineage(out.withColumns(_doubled("job", "job_sq")))


def _passes(filters: list[str]) -> Column:
    """Both sides must be known for a filter to reject."""
    ok = F.lit(True)
    for f in filters:
        want, have = F.nullif(F.col("want_" + f), F.lit("")), F.nullif(F.col(f), F.lit(""))
        ok = ok & (want.isNull() | have.isNull() | (want == have))
    return ok


def _lists(asked: DataFrame, idf: DataFrame, filters: list[str], only_known: bool) -> DataFrame:
    """A row per query and skill: the skill, the sums over it and all lighter skills of the query (rest),
    those skills (later), and the names of the heavier ones (earlier).

    A profile whose heaviest skill shared with the query is this one can get no more than the rest.
    """
    wants = ["want_" + f for f in filters]
    mine = _weights(asked, "_q", idf, "mine", wants)
    skills = F.filter("mine_skills", lambda s: s["known"]) if only_known else F.col("mine_skills")
    ranked = mine.select("_q", *wants, "mine", "mine_sq", "mine_n", F.reverse(F.array_sort(skills)).alias("ranked"))
    rows = ranked.select("*", F.posexplode("ranked").alias("at", "skill")).select(
        "_q", *wants, "mine", "mine_sq", "mine_n", F.col("skill.tech").alias("tech"),
        F.slice("ranked", F.col("at") + 1, F.size("ranked")).alias("later"),
        F.slice("ranked", F.lit(1), F.col("at"))["tech"].alias("earlier"))
    zero = F.lit(0.0)
    return rows.withColumns(_doubled("mine", "mine_sq")).select(
        "*", F.aggregate("later", zero, lambda t, x: t + x["w"].cast("double")).alias("rest"),
        F.aggregate("later", zero, lambda t, x: t + x["sq"].cast("double")).alias("rest_sq"), F.size("later").cast("long").alias("rest_n"))


def _shared_sums(squares: bool) -> dict[str, Column]:
    """What the skills in `shared` add up to, exactly: weights in whole units of 10**-12, squares as decimals."""
    units = F.aggregate("shared", F.lit(0).cast("long"), lambda t, s: t + s["units"])
    sq = F.aggregate("shared", F.lit(0).cast(_SQUARES), lambda t, s: (t + s["sq"]).cast(_SQUARES)) if squares else F.lit(0).cast(_SQUARES)
    return {"hit": (units.cast("decimal(20,0)") * F.lit("0.000000000001").cast("decimal(12,12)")).cast(_SUM),
            "hit_sq": sq, "hit_n": F.size("shared").cast("long")}


def _floors(best: DataFrame, lists: DataFrame, k: int, n: int) -> DataFrame:
    """`lists` with the score that a slot of the query has k results of, -1 where it has fewer."""
    reached = best.where(F.col("rank") == k).groupBy(F.expr(f"slot div {n}").alias("_q")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("slot") % n).cast("int").alias("i"), "score"))).alias("_reached"))
    at_least = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("_reached", i), F.lit(-1.0)))
    return lists.drop("floor").join(reached, "_q", "left").withColumn("floor", at_least).drop("_reached")


def _scored(lists: DataFrame, profiles: DataFrame, filters: list[str], scores: dict[str, Column], small: bool,
            by_count: bool) -> DataFrame:
    """(slot, profile, entity, score) of the profiles that share a skill and reach the slot's floor.

    A slot is a query under one scheme, as one number: _q x schemes + place. All scores grow with what is
    shared, and a pair shares no more than the smaller of the profile and the query's rest. Only pairs
    whose score of that much would reach a floor are looked at, each by the heaviest skill it shares.
    With broadcast lists nothing but the answers is shuffled.
    """
    sums = ("job", "job_sq", "e_job", "e_job_sq", "job_n")
    held = profiles.select("profile", "entity", *filters, "techs", *sums, F.explode("techs").alias("tech"))
    pairs = held.join(F.broadcast(lists) if small else lists, "tech").where(_passes(filters))
    most = pairs.withColumns({"hit": F.least("job", "rest"), "hit_sq": F.least("job_sq", "rest_sq"), "hit_n": F.least("job_n", "rest_n")})
    likely = most.where(reduce(lambda a, b: a | b, (c + 1e-9 >= F.col("floor")[i] for i, c in enumerate(scores.values()))))
    first = likely.where(~F.arrays_overlap("techs", "earlier"))
    hits = (F.array_intersect("techs", F.col("later")["tech"]) if by_count
            else F.filter("later", lambda s: F.array_contains("techs", s["tech"])))
    shared = computed(first, hits.alias("shared"),
                      keep=("profile", "entity", "_q", "floor", "e_job", "e_job_sq", "job_n", "e_mine", "e_mine_sq", "mine_n"))
    shared = shared.withColumnsRenamed({f"e_{n}": n for n in ("job", "job_sq", "mine", "mine_sq")})
    squares = any("_sq" in str(c) for c in scores.values())
    sums = {"hit_n": F.size("shared").cast("long")} if by_count else _shared_sums(squares)
    exact = computed(shared, *(c.alias(n) for n, c in sums.items()))
    rows = F.array(*(F.struct((F.col("_q") * len(scores) + i).alias("slot"), c.alias("score"), F.col("floor")[i].alias("least"))
                     for i, c in enumerate(scores.values())))
    return exact.select("profile", "entity", F.inline(rows)).where("score >= least").drop("least")


def _scored_together(asked: DataFrame, profiles: DataFrame, idf: DataFrame, filters: list[str],
                     scores: dict[str, Column], small: bool) -> DataFrame:
    """`_scored` for several schemes: no bound holds for all of them, so what each pair shares is summed once
    and scored under every scheme. `profiles` stay on their partitions up to the sums."""
    wants = ["want_" + f for f in filters]
    mine = _weights(asked, "_q", idf, "mine", wants).select(
        "_q", *wants, "mine", "mine_sq", "mine_n", F.explode("mine_skills.tech").alias("tech"))
    held = _weights(profiles.select("profile", "entity", *filters, "techs"), "profile", idf, "job", ["entity", *filters]).select(
        "profile", "entity", *filters, "job", "job_sq", "job_n", F.inline("job_skills")).drop("known", "units")
    # constants of a side are taken as maxima: numbers keep this a hash aggregation
    sides = ("job", "job_sq", "job_n", "mine", "mine_sq", "mine_n")
    sums = (held.join(F.broadcast(mine) if small else mine, "tech").where(_passes(filters))
            .groupBy("profile", "entity", "_q").agg(
                F.sum("w").alias("hit"), F.sum("sq").alias("hit_sq"), F.count(F.lit(1)).alias("hit_n"),
                *(F.max(c).alias(c) for c in sides)))
    rows = F.array(*(F.struct((F.col("_q") * len(scores) + i).alias("slot"), c.alias("score"))
                     for i, c in enumerate(scores.values())))
    return sums.select("profile", "entity", F.inline(rows))


def _over(x, y):
    return np.divide(x, y, out=np.zeros(np.broadcast_shapes(x.shape, y.shape)), where=y > 0)


def _or_1(x):
    return np.where(x > 0, x, 1.0)


# The same scores over arrays of a batch of rows (down) and all queries (across), to choose by.
_ARRAYS = {
    SCORERS["raw_idf"]: lambda v: v["hit"],
    SCORERS["length_norm"]: lambda v: v["hit"] / _or_1(np.sqrt(v["job"])),
    SCORERS["jaccard"]: lambda v: _over(v["hit_n"], v["mine_n"] + v["job_n"] - v["hit_n"]),
    SCORERS["cosine"]: lambda v: v["hit_sq"] / (_or_1(np.sqrt(v["mine_sq"])) * _or_1(np.sqrt(v["job_sq"]))),
    SCORERS["per_skill_count"]: lambda v: _over(v["hit"], v["job_n"]),
    SCHEMES["linear"]: lambda v: v["hit"] / _or_1(v["job"]),
    SCHEMES["jaccard"]: lambda v: _over(v["hit"], (v["job_units"] + v["mine_units"] - v["hit_units"]) / 1e12),
}
# Queries and their skills beyond these are joined as rows.
MOST_QUERIES, MOST_SKILLS = 20_000, 5_000
_LIMB = float(1 << 23)


def _nearest(mine: list, names: list[str], formulas: list, filters: list[str], k: int):
    """Per task, of each (query, scheme) the k best entities of its rows, which come in the entities' order."""
    place = {t: i for i, t in enumerate(sorted({t for r in mine for t in r["techs"]}))}
    units = np.zeros((len(place), len(mine)))
    has = np.zeros_like(units)
    for q, r in enumerate(mine):
        for t, u in zip(r["techs"], r["units"]):
            units[place[t], q], has[place[t], q] = u, 1.0
    high, low = np.floor(units / _LIMB), units % _LIMB
    sides = {c: np.array([float(r[c]) for r in mine]) for c in ("mine", "mine_sq", "mine_n")}
    sides["mine_units"] = units.sum(0)
    wants = {f: [r["want_" + f] or None for r in mine] for f in filters}
    words, ids, n = pa.array(place, pa.string()), np.array([r["_q"] for r in mine]), len(formulas)

    def scores(b: pa.RecordBatch) -> list[np.ndarray]:
        techs = b.column("techs")
        at = pc.index_in(techs.flatten(), words)
        rows, known = np.repeat(np.arange(b.num_rows), np.diff(techs.offsets.to_numpy())), at.is_valid().to_numpy(zero_copy_only=False)
        held = np.zeros((b.num_rows, len(place)))
        held[rows[known], at.drop_null().to_numpy()] = 1.0
        v = sides | {c: b.column(c).to_numpy(zero_copy_only=False).astype(float)[:, None] for c in ("job", "job_sq", "job_n")}
        v["job_units"], v["hit_units"], v["hit_n"] = np.rint(v["job"] * 1e12), held @ units, held @ has
        v["hit"] = v["hit_units"] / 1e12
        # whole numbers below 2**53, so sums do not depend on their order
        v["hit_sq"] = ((held @ (high * high)) * _LIMB * _LIMB + (held @ (high * low)) * 2 * _LIMB + held @ (low * low)) / 1e24
        out = v["hit_n"] > 0
        for f in filters:
            for i, have in enumerate(b.column(f).to_pylist()):
                if have:
                    out[i] &= np.array([w is None or w == have for w in wants[f]])
        return [np.where(out, np.rint(formula(v) * 1e12) / 1e12, -1.0) for formula in formulas]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.full((len(mine), k), -1.0), np.zeros((len(mine), k), np.int64), np.zeros((len(mine), k), np.int64)) for _ in formulas]
        shown, last, entity, row, size = {}, None, -1, 0, 16
        for whole in batches:
            done = 0
            while done < whole.num_rows:
                b = whole.slice(done, size)
                done, size, named = done + b.num_rows, min(size * 4, 1024), b.column("entity").to_pylist()
                numbers = np.empty(b.num_rows, np.int64)
                for i, e in enumerate(named):
                    entity += e != last
                    numbers[i], last = entity, e
                for (score, which, rows), got in zip(best, scores(b)):
                    r, q = np.nonzero(got > score[:, -1])
                    if not len(r):
                        continue
                    hit = np.unique(q)
                    qs, ss = np.concatenate([q, np.repeat(hit, k)]), np.concatenate([got[r, q], score[hit].ravel()])
                    es, rs = np.concatenate([numbers[r], which[hit].ravel()]), np.concatenate([row + r, rows[hit].ravel()])
                    # an entity once, with its best score and of equal ones its first row; then the best entities
                    order = np.lexsort((rs, -ss, es, qs))
                    qs, ss, es, rs = qs[order], ss[order], es[order], rs[order]
                    first = np.ones(len(qs), bool)
                    first[1:] = (qs[1:] != qs[:-1]) | (es[1:] != es[:-1]) | (ss[1:] < 0)
                    qs, ss, es, rs = qs[first], ss[first], es[first], rs[first]
                    order = np.lexsort((es, -ss, qs))
                    qs, ss, es, rs = qs[order], ss[order], es[order], rs[order]
                    rank = np.arange(len(qs)) - np.searchsorted(qs, qs)
                    kept = (rank < k) & (ss >= 0)
                    score[hit] = -1.0
                    for to, values in ((score, ss), (which, es), (rows, rs)):
                        to[qs[kept], rank[kept]] = values[kept]
                    profile = b.column("profile")
                    for i in np.unique(rs[kept & (rs >= row)]).tolist():
                        shown[i] = profile[i - row].as_py(), named[i - row]
                row += b.num_rows
        for i, (score, _, rows) in enumerate(best):
            q, r = np.nonzero(score >= 0)
            found = [shown[x] for x in rows[q, r].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[q] * n + i, pa.int64()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], named_type)],
                names=["slot", "profile", "entity"])
    named_type = pa.string() if "string" in names else pa.int64()
    return search


def _scored_by_arrays(asked: DataFrame, rows: DataFrame, idf: DataFrame, filters: list[str], scores: dict[str, Column],
                      formulas: list, k: int) -> DataFrame:
    """`_scored_together` of the k best entities per slot and task alone: products of matrices choose them, then the
    pairs that are left are scored exactly. `rows`: profile, entity, row, techs and sums, a written stage."""
    wants = ["want_" + f for f in filters]
    mine = cut_lineage(_weights(asked, "_q", idf, "mine", wants))
    held = mine.select("_q", *wants, "mine", "mine_sq", "mine_n", F.col("mine_skills.tech").alias("techs"), F.col("mine_skills.units").alias("units")).collect()
    kind = rows.schema["entity"].dataType
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = rows.select("profile", "entity", "row", *filters, "techs", "job", "job_sq", "job_n")
    dealt = sides.repartition(n, F.xxhash64("profile", "entity")).sortWithinPartitions("entity", "row")
    schema = StructType([StructField("slot", LongType()), StructField("profile", StringType()), StructField("entity", kind)])
    chosen = cut_lineage(dealt.mapInArrow(_nearest(held, [kind.simpleString()], formulas, filters, k), schema))
    pairs = _rejoined(chosen.withColumn("_q", F.expr(f"slot div {len(scores)}")).join(mine.select("_q", "mine_skills", *("mine" + s for s in ("", "_sq", "_n"))), "_q"),
                      rows.select("profile", "entity", "techs", F.col("e_job").alias("job"), F.col("e_job_sq").alias("job_sq"), "job_n"))
    shared = pairs.withColumn("shared", F.filter("mine_skills", lambda s: F.array_contains("techs", s["tech"])))
    exact = computed(shared, *(c.alias(x) for x, c in _shared_sums(True).items()))
    return exact.select("profile", "entity", "slot", F.array(*scores.values())[(F.col("slot") % len(scores)).cast("int")].alias("score"))


def _rejoined(chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """`chosen` with its rows' columns; an entity may be NULL."""
    other = rows.withColumnsRenamed({"profile": "_p", "entity": "_e"})
    return chosen.join(other, (F.col("profile") == F.col("_p")) & F.col("entity").eqNullSafe(F.col("_e"))).drop("_p", "_e")


def _formulas(asked: DataFrame, modes: list[str], registry: dict[str, Scorer], kind: str) -> list | None:
    """The array forms of several schemes, if they are known and the queries are few enough."""
    if len(modes) < 2 or kind not in ("string", "bigint") or any(registry[m] not in _ARRAYS for m in modes):
        return None
    size = asked.select(F.explode("techs").alias("t"), "_q").agg(F.count_distinct("_q"), F.count_distinct("t")).first()
    return [_ARRAYS[registry[m]] for m in modes] if size[0] <= MOST_QUERIES and size[1] <= MOST_SKILLS else None


def _best(rows: DataFrame, k: int, key: str = "slot") -> DataFrame:
    """The k best rows per key; each task drops the rest of its own first."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "entity")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _is_small(queries: DataFrame) -> bool:
    """Whether the rows may be sent to all tasks, by their measured bytes."""
    return measured_bytes(queries) <= LOOKUP_BYTES


def _single_profile_matches(asked, lists, members, idf, k, filters, scores, small, by_count, formulas=None) -> DataFrame:
    """Entities with one profile: the k best profiles (by score, then first
    entity) hold the k best entities. A few profiles are scored before the others, for the floors."""
    profiles = _profiles(members, k, ["techs", *filters])
    if formulas:
        profiles = _summed(profiles.withColumn("row", F.col("entity")), idf, False)
        best = _best(_scored_by_arrays(asked, profiles, idf, filters, scores, formulas, k), k).drop("entity", "rank")
        return _entities(best, profiles, k)
    if len(scores) > 1:
        best = _best(_scored_together(asked, profiles, idf, filters, scores, small), k).drop("entity", "rank")
        return _entities(best, profiles, k)
    profiles = _summed(profiles, idf, by_count)
    n = len(scores)
    seeds = profiles.where(F.pmod(F.xxhash64("profile"), F.lit(max(1, profiles.count() // SEED_PROFILES))) == 0)
    open_lists = lists.withColumn("floor", F.array_repeat(F.lit(-1.0), n))
    floors = cut_lineage(_floors(_best(_scored(open_lists, seeds, filters, scores, small, by_count), k), lists, k, n))
    best = _best(_scored(floors, profiles, filters, scores, small, by_count), k).drop("entity", "rank")
    return _entities(best, profiles, k)


def _entities(best: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    hits = best.join(profiles.select("profile", "techs", "entities"), "profile").select(
        "slot", "score", "techs", F.explode("entities").alias("entity"))
    return _best(hits, k)


def _shared_profile_matches(asked, lists, members, idf, filters, scores, small, by_count, formulas=None, k=0) -> DataFrame:
    """Entities with several profiles count with their best one, and of equally good ones the one that
    comes first in the pool: pre-aggregated per (query, entity), so a hot entity makes no hot task."""
    if formulas:
        sums = _summed(members.groupBy("profile").agg(F.first("techs").alias("techs")), idf, False).drop("techs")
        rows = cut_lineage(members.join(sums, "profile"))
        scored = _scored_by_arrays(asked, rows, idf, filters, scores, formulas, k)
        return _first_of_best(_rejoined(scored, members.select("profile", "entity", "row", "techs")))
    profiles = _spread_profiles(members.groupBy("profile").agg(
        *(F.first(c).alias(c) for c in ["techs", *filters]), F.min("entity").alias("entity")))
    scored = (_scored_together(asked, profiles, idf, filters, scores, small) if len(scores) > 1
              else _scored(lists, _summed(profiles, idf, by_count), filters, scores, small, by_count)).drop("entity")
    links = members.select(F.upper("profile").alias("profile"), "entity", "row", "techs")
    return _first_of_best(scored.join(links, "profile"))


def _first_of_best(scored: DataFrame) -> DataFrame:
    return (scored.groupBy("slot", "entity")
            .agg(F.min(F.struct((-F.col("score")).alias("less"), "row", "techs")).alias("b"))
            .select("slot", (-F.col("b.less")).alias("score"), "b.techs", "entity"))


def top_matches_by_scheme(queries: DataFrame, pool: DataFrame, idf: DataFrame, k: int,
                          modes: list[str], registry: dict[str, Scorer] = SCORERS,
                          entity: str = "job_id", unique_entity: bool = False,
                          filters: tuple = (), only_known: bool = False) -> DataFrame:
    """`top_matches` for several score modes in one pass, told apart by `scheme`.

    `only_known` says that skills without a weight occur in no posting.
    """
    scores, names, n = {m: scorer(m, registry) for m in modes}, list(filters), len(modes)
    by_count = all(registry[m] in _BY_COUNT for m in modes)
    asked = cut_lineage(queries.select(F.monotonically_increasing_id().alias("_q"), "query_id",
                                       F.array_distinct("techs").alias("techs"),
                                       *("want_" + f for f in names)))
    idf = small_side(idf.select("tech", "idf"))
    lists = cut_lineage(_lists(asked, idf, names, only_known))
    small = _is_small(lists.select("_q", "later", "earlier") if n == 1 else asked.select("_q", F.explode("techs").alias("tech")))
    members = _members(pool, entity, names)
    formulas = _formulas(asked, modes, registry, members.schema["entity"].dataType.simpleString())
    if unique_entity:
        best = _single_profile_matches(asked, lists, members, idf, k, names, scores, small, by_count, formulas)
    else:
        # read several times below, and narrow: written once
        members = cut_lineage(members.groupBy("profile", "entity").agg(
            F.min("row").alias("row"), *(F.first(c).alias(c) for c in ["techs", *names])))
        several = cut_lineage(members.groupBy("entity").agg(F.count(F.lit(1)).alias("_p")).where("_p > 1").select("entity"))
        if several.isEmpty():
            best = _single_profile_matches(asked, lists, members, idf, k, names, scores, small, by_count, formulas)
        else:
            single = members.join(several, "entity", "left_anti")
            shared = members.join(several, "entity", "left_semi")
            alone = cut_lineage(_single_profile_matches(asked, lists, single, idf, k, names, scores, small, by_count, formulas))
            floors = cut_lineage(_floors(alone, lists, k, n))
            best = _best(alone.drop("rank").unionByName(
                _shared_profile_matches(asked, floors, shared, idf, names, scores, small, by_count, formulas, k)), k)
    mine = asked.select("_q", "query_id", F.col("techs").alias("_mine"))
    place = (F.col("slot") % n).cast("int")
    return (best.withColumn("_q", F.expr(f"slot div {n}")).join(mine, "_q")
            .withColumn("scheme", F.array(*(F.lit(m) for m in modes))[place])
            .withColumn("matched_techs", F.sort_array(F.array_intersect("techs", "_mine")))
            .select("scheme", "query_id", "rank", F.col("entity").alias(entity), "score",
                    "matched_techs", F.size("matched_techs").alias("matched_count")))


def top_matches(queries: DataFrame, pool: DataFrame, idf: DataFrame, k: int = 10,
                mode: str = DEFAULT_SCORER, registry: dict[str, Scorer] = SCORERS,
                entity: str = "job_id", unique_entity: bool = False,
                filters: tuple = (), only_known: bool = False) -> DataFrame:
    """(query_id, rank, entity, score, matched_techs, matched_count).

    queries: query_id, techs and, for each filter, want_<filter>. Ordered by
    score, then entity; an entity is listed once, with its best score, and of equally good postings with
    the skills of the one with the smallest row_id. `unique_entity` says that no entity occurs in two pool rows.
    """
    return top_matches_by_scheme(queries, pool, idf, k, [mode], registry, entity, unique_entity,
                                 filters, only_known).drop("scheme")


# ---------------------------------------------------------------- optional expansions

def expand_related(queries: DataFrame, related: DataFrame) -> DataFrame:
    """Adds to each query the technologies its own ones usually come with."""
    own = queries.select("query_id", F.explode("techs").alias("base"))
    added = (own.join(related, "base").select("query_id", F.explode("related").alias("tech"))
             .groupBy("query_id").agg(F.collect_set("tech").alias("_more")))
    return (queries.join(added, "query_id", "left")
            .withColumn("techs", F.sort_array(F.array_union(
                "techs", F.coalesce("_more", F.array().cast("array<string>")))))
            .drop("_more"))


def build_related_map(sets: DataFrame, idf: DataFrame, min_ratio: float = 0.5,
                      top: int = 2) -> DataFrame:
    return related_map(cooccurrence(sets, idf.select("tech")), min_ratio, top)


def extra_vocabulary(pool: DataFrame, min_df: int = 5) -> DataFrame:
    """Skills outside the dictionary that at least `min_df` postings ask for."""
    return (pool.select(F.explode("skills_extra").alias("skill")).groupBy("skill")
            .agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df).select("skill"))


def extras_in_text(queries: DataFrame, vocabulary: DataFrame, text: str = "resume_text") -> DataFrame:
    """(query_id, techs): vocabulary entries contained in each text.

    A containment join on the first two characters: each text is cut into its
    distinct character pairs, so an entry meets only texts that can hold it.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    pairs = queries.select("query_id", low.alias("_low")).withColumn(
        "_pair", F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(F.length("_low"), F.lit(1))),
            lambda i: F.substring("_low", i, F.lit(2))))))
    heads = vocabulary.select("skill", F.substring("skill", 1, 2).alias("_pair"))
    wide = pairs.join(heads.where(F.length("skill") >= 2), "_pair")
    one = (queries.select("query_id", low.alias("_low"), F.explode(F.array_distinct(F.split(low, "")))
                          .alias("_pair"))
           .join(heads.where(F.length("skill") == 1), "_pair"))
    return (wide.unionByName(one).where(F.contains("_low", "skill"))
            .groupBy("query_id").agg(F.sort_array(F.collect_set("skill")).alias("techs")))


# ---------------------------------------------------------------- word overlap

def words_of(text: Column) -> Column:
    """Distinct lower-case words of at least two characters."""
    words = F.transform(every(F.coalesce(text, F.lit("")), WORD), lambda w: F.lower(w))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))


def text_matches(queries: DataFrame, pool: DataFrame, k: int = 10, text: str = "resume_text",
                 pool_text: str = "raw_text", filters: tuple = ()) -> DataFrame:
    """Postings by word-set overlap (Jaccard), for résumés without any known skill.

    A search for the k most similar sets: words are taken rarest first, and a posting is met by the rarest
    word it shares. How similar it can still be then follows from the words left over, so the frequent
    ones are hardly looked at once a query has k results. Postings with the same words (and filtered
    fields) are compared once.
    """
    names = list(filters)
    wants = ["want_" + f for f in names]
    asked = cut_lineage(queries.select("query_id", *wants, words_of(F.col(text)).alias("techs")).where(F.size("techs") > 0))
    rows = cut_lineage(pool.select("job_id", *names, words_of(F.col(pool_text)).alias("techs")).where(F.size("techs") > 0))
    wanted = small_side(asked.select(F.explode("techs").alias("tech")).distinct())
    df = rows.select(F.explode("techs").alias("tech")).join(wanted, "tech").groupBy("tech").agg(F.count(F.lit(1)).alias("df"))
    rarity = df.select("tech", (F.lit(1.0) / F.col("df")).cast("decimal(18,12)").alias("idf"))
    best = top_matches(asked, rows, rarity, k, "jaccard", filters=filters, only_known=True)
    return best.select("query_id", "rank", "job_id", "score", F.lit("text_overlap").alias("fallback"))


# ---------------------------------------------------------------- the entry

@dataclass(frozen=True)
class Flags:
    """What may be switched on beside the plain match; `related_share` is how often a technology must come along."""
    hypernyms: bool = False
    related: bool = False
    extras: bool = False
    text_fallback: bool = False
    related_share: float = 0.5


def recommend(resumes: DataFrame, corpus: DataFrame, as_of, k: int = 10, filters: tuple = (), flags: Flags = Flags(),
              mode: str = DEFAULT_SCORER, backfill: DataFrame | None = None, only_open: bool = False) -> DataFrame:
    """(query_id, rank, job_id, score, matched_techs, matched_count, fallback) of each résumé's k best postings.

    resumes: query_id, resume_text and, for each of `filters`, want_<filter>; corpus: postings with techs and
    skills_extra, best as a written stage, since it is read several times. The pool is that of `as_of`;
    weights come from the whole corpus. A résumé without any
    skill gets nothing, or, with the flag, postings by the overlap of words (fallback `text_overlap`).
    """
    if mode not in SCORERS:
        raise ValueError(f"unknown score mode {mode!r}; known: {', '.join(SCORERS)}")
    none = F.array().cast("array<string>")
    wants = ["want_" + f for f in filters]
    idf = cut_lineage(tech_idf(corpus))
    pool = recommendation_pool(corpus, as_of, backfill, only_open).select(
        "row_id", "job_id", *FILTERS, "techs", "skills_extra", *(["raw_text"] if flags.text_fallback else []))
    pool = cut_lineage(pool)
    mine = resumes.select("query_id", "resume_text", *wants, extract_techs(F.col("resume_text")).alias("techs"))
    if flags.hypernyms:
        mine = mine.withColumn("techs", expand_hypernyms(F.col("techs")))
    mine = cut_lineage(mine)
    jobs = pool
    if flags.related:
        sets = corpus.where(F.size("techs") > 0).select("row_id", "techs")
        mine = expand_related(mine, build_related_map(sets, idf, flags.related_share))
    if flags.extras:
        extra = extras_in_text(resumes, extra_vocabulary(corpus)).withColumnRenamed("techs", "_extra")
        mine = mine.join(extra, "query_id", "left").withColumn("techs", F.array_union("techs", F.coalesce("_extra", none))).drop("_extra")
        jobs = jobs.withColumn("techs", F.array_union("techs", "skills_extra"))
    mine = cut_lineage(mine)
    best = top_matches(mine.where(F.size("techs") > 0), jobs, idf, k, mode, filters=filters).withColumn("fallback", F.lit(None).cast("string"))
    if not flags.text_fallback:
        return best
    rest = text_matches(mine.where(F.size("techs") == 0).drop("techs"), pool, k, filters=filters)
    return best.unionByName(rest.select("query_id", "rank", "job_id", "score", none.alias("matched_techs"),
                                        F.lit(0).alias("matched_count"), "fallback"))
