"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word n-grams. In any fixed order of n-grams, two sets whose overlap is at
least `need` share at least l n-grams within the first |x| - need + l of x and |y| - need + l of y. Rare
n-grams come first in the order. Each document chooses its own l: the longer the prefix, the more n-grams
two documents must share there before they are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gonggo.llm import bytetext, exchange
from gonggo.llm.components import components
from gonggo.session import arrow_rows, lookup, short_lived, written

# Counters of the frequency sketch (1 MB when broadcast as classes) and the longest l.
SLOTS, LONGEST_MATCH = 1 << 20, 8
# 64-bit words of a set's parity sketch.
SKETCH_WORDS = 8
# Open n-grams before its own that each row of the pair join knows, where it is asked for.
EARLIER = 4
# Texts or sets that one Arrow batch holds.
BATCH_ROWS = 1000
_SLOT_SHIFT, _PART = np.uint64(44), 4096
_CELL = np.dtype([("slot", "u2"), ("count", "u4")])


@dataclass(frozen=True)
class Rule:
    """Sets of `n`-grams link when `den` * overlap >= `num` * union."""

    n: int = 3
    num: int = 90
    den: int = 100

    def least_overlap(self, size: np.ndarray) -> np.ndarray:
        """The overlap that a set of this size needs with any other."""
        return -(-self.num * size // self.den)

    def need(self, x: Column, y: Column) -> Column:
        """The overlap that two sets of these sizes need."""
        whole = self.num + self.den
        return F.floor((F.lit(self.num) * (x + y) + F.lit(whole - 1)) / F.lit(whole))

    def links(self, x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return self.den * both >= self.num * (len(x) + len(y) - both)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every n-gram, repeats included; a text of fewer words has them all as one."""
    starts, ends, rows = bytetext.words(data, offsets, bytetext.BLANK_WORDS)
    words = bytetext.word_hashes(data, starts, ends, bytetext.BLANK_WORDS)
    window, whole = bytetext.window_hashes(words, rows, n)
    found, where = [window[whole]], [rows[:len(window)][whole]]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            window, _ = bytetext.window_hashes(words, rows, size)
            found.append(window[first[short]])
            where.append(short)
    return np.concatenate(found), np.concatenate(where)


def frequency_classes(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """A class for each slot of n-gram hashes: 0 up to twice the mean count, one more for each doubling.

    Counted over all documents, in tasks, into a fixed number of slots; what meets and is broadcast does not
    grow with the data. It only orders n-grams: results are the same under any order.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in bytetext.released(batches):
            data, offsets = bytetext.text_bytes(batch.column(0))
            for low, high in bytetext.slices(offsets, bytetext.FINE_BYTES):
                hashes, _ = shingles(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], n)
                met, times = np.unique(hashes >> _SLOT_SHIFT, return_counts=True)
                total[met.astype(np.int64)] += times
        met = np.flatnonzero(total)
        cells = np.empty(len(met), _CELL)
        cells["slot"], cells["count"] = met % _PART, total[met]
        parts, begin = np.unique(met // _PART, return_index=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts.astype(np.int32)), pa.array([c.tobytes() for c in np.split(cells, begin[1:])][:len(parts)], pa.binary())],
            ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in bytetext.released(batches):
            for part, counts in zip(*(c.to_pylist() for c in batch.columns)):
                cells = np.frombuffer(counts, _CELL)
                total.setdefault(part, np.zeros(_PART, np.int64))[cells["slot"]] += cells["count"]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                              pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "counts"])

    kind = "part int, counts binary"
    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, kind).repartition("part").mapInArrow(add, kind)
    counts = np.zeros((SLOTS // _PART, _PART), np.int64)
    for row in counted.toLocalIterator():
        counts[row.part] = np.frombuffer(row.counts, np.int64)
    scale = max(2 * counts.mean(), 8.0)
    return np.maximum(np.floor(np.log2(np.maximum(counts.ravel(), 1) / scale)) + 1, 0).astype(np.uint8)


_PREFIXES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("n", T.LongType()),
    T.StructField("sid", T.LongType()), T.StructField("ell", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.LongType())),
    T.StructField("odd", T.ArrayType(T.LongType())), T.StructField("tie", T.LongType())])
_SET_SEED = np.uint64(0x2545F4914F6CDD1D)


def _sorted_sets(data: np.ndarray, offsets: np.ndarray, n: int, classes: np.ndarray | None = None):
    """Distinct n-grams by row and order, the first place of each row that has any, sizes and set hashes."""
    hashes, rows = shingles(data, offsets, n)
    keys = (hashes, rows) if classes is None else (hashes, classes[(hashes >> _SLOT_SHIFT).astype(np.int64)], rows)
    order = np.lexsort(keys)
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    sizes = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(sizes) - sizes
    sid = np.zeros(len(sizes), np.uint64)
    some = sizes > 0
    if some.any():
        sid[some] = np.add.reduceat(bytetext.mix(hashes ^ _SET_SEED), first[some])
    return hashes, first, sizes, bytetext.mix(sid + sizes.astype(np.uint64)).view(np.int64)


def set_hash(text: Column, n: int) -> Column:
    """The `sid` of a text's set of n-grams; null if it has none."""
    @F.arrow_udf(T.LongType())
    def read(column: pa.Array) -> pa.Array:
        data, offsets = bytetext.text_bytes(column)
        out = [pa.array([], pa.int64())]
        for low, high in bytetext.slices(offsets, bytetext.FINE_BYTES):
            _, _, sizes, sid = _sorted_sets(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], n)
            out.append(pa.array(sid, mask=sizes == 0))
        return pa.concat_arrays(out)

    return read(text.cast("string"))


def _match_lengths(classes: np.ndarray, hashes: np.ndarray, first: np.ndarray, sizes: np.ndarray, rule: Rule) -> np.ndarray:
    """Each row's l of least estimated cost: postings met in the prefix, and candidates to verify.

    The candidates that share l n-grams are at most the postings over l; one costs as much as its set.
    """
    of = classes[(hashes >> _SLOT_SHIFT).astype(np.int64)]
    about = np.where(of == 0, 2.0, 8.0 * 2.0 ** of)
    total = np.concatenate([[0.0], np.cumsum(about)])
    least = rule.least_overlap(sizes)
    best, ell = np.full(len(sizes), np.inf), np.ones(len(sizes), np.int64)
    for length in range(1, LONGEST_MATCH + 1):
        prefix = np.minimum(sizes - least + length, sizes)
        postings = total[first + prefix] - total[first]
        cost = np.where(length <= np.maximum(least, 1), postings * (1 + sizes / 16 / length), np.inf)
        better = cost < best
        best[better], ell[better] = cost[better], length
    return ell


def parity_sketches(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row, which of 64 * SKETCH_WORDS cells an odd number of its n-grams falls into.

    Two sets differ in at least as many n-grams as their sketches differ in bits.
    """
    bits = 64 * SKETCH_WORDS
    row = np.repeat(np.arange(len(sizes)), sizes)
    cells = np.bincount(row * bits + (bytetext.mix(hashes) % np.uint64(bits)).astype(np.int64), minlength=len(sizes) * bits)
    return np.packbits((cells & 1).astype(bool).reshape(len(sizes), bits), axis=1).view(np.int64)


def prefixes(docs: DataFrame, rule: Rule, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, block, n (set size), sid (hash of the set), ell, tokens (the prefix), odd (the parity
    sketch) and tie (hash of the text) of each document, as a written stage."""
    classes = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, text, rule.n))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, of = TaskContext.get().partitionId(), classes.value
        for batch in bytetext.released(batches):
            data, offsets = bytetext.text_bytes(batch.column(1))
            for low, high in bytetext.slices(offsets, bytetext.FINE_BYTES):
                hashes, first, sizes, sid = _sorted_sets(
                    data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], rule.n, of)
                ell = _match_lengths(of, hashes, first, sizes, rule)
                length = np.where(sizes > 0, np.minimum(sizes - rule.least_overlap(sizes) + ell, sizes), 0)
                where = np.concatenate([[0], np.cumsum(length)])
                take = np.arange(where[-1]) - np.repeat(where[:-1], length) + np.repeat(first, length)
                tokens = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(hashes[take].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.full(high - low, block, np.int32)),
                     pa.array(sizes.astype(np.int64)), pa.array(sid), pa.array(ell.astype(np.int32)), tokens,
                     pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * SKETCH_WORDS, pa.int32()),
                                              pa.array(parity_sketches(hashes, sizes).ravel())),
                     batch.column(2).slice(low, high - low)],
                    ["doc_id", "block", "n", "sid", "ell", "tokens", "odd", "tie"])

    value = F.col(text).cast("string")
    chosen = docs.select(F.col(doc_id).cast("bigint"), value, F.xxhash64(value).alias("tie"))
    return written(chosen.mapInArrow(read, _PREFIXES), "prefixes")


_POSTINGS = "token long, sid long, n long, ell int, pos int"


def postings(stage: DataFrame) -> DataFrame:
    """token, sid, n, ell, pos: the prefix n-grams that several documents have in their prefixes, once per set.

    An n-gram left out may still lie behind another document's prefix, so what is left of a set says nothing
    about its largest overlap.
    """
    spark = stage.sparkSession
    buckets = exchange.bucket_count(spark)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = exchange.Sender(buckets)
        for batch in bytetext.released(batches):
            tokens = batch.column(1)
            blocks = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
            yield from sender.add(tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64), blocks)
        yield from sender.flush()

    def match(rows: pa.Table, answers: pa.Table) -> pa.Table:
        keys = exchange.known(answers)
        lists = rows["tokens"].combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        tokens = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(counts)), counts)
        pos = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
        keep = exchange.is_known(tokens.view(np.uint64), keys)
        of = pa.array(row[keep])
        return pa.table({"token": tokens[keep], "sid": rows["sid"].take(of), "n": rows["n"].take(of),
                         "ell": rows["ell"].take(of), "pos": pos[keep].astype(np.int32)})

    some = stage.where("n > 0")
    # Three steps, so that the shuffle files of one go before the next one makes its own.
    with short_lived(spark) as kept:
        answers = written(exchange.repeated(some.select("block", "tokens").mapInArrow(send, exchange.SENT)), "answers")
        found = written(some.select("block", "sid", "n", "ell", "tokens").groupBy("block").cogroup(
            answers.groupBy("block")).applyInArrow(match, _POSTINGS), "found")
        return kept(found.groupBy("token", "sid").agg(
            F.max("n").alias("n"), F.max("ell").alias("ell"), F.min("pos").alias("pos")))


def _renamed(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{c}_{side}") for c in rows.columns])


def _side(rows: DataFrame, side: str) -> DataFrame:
    return _renamed(rows, side).withColumnRenamed(f"token_{side}", "token")


def _matches(rule: Rule) -> Column:
    """Whether an n-gram lies within both prefixes of the pair's own l."""
    need = rule.need(F.col("n_x"), F.col("n_y"))
    ell = F.least("ell_x", "ell_y")
    return (F.col("pos_x") < F.col("n_x") - need + ell) & (F.col("pos_y") < F.col("n_y") - need + ell)


def _first_match(rule: Rule) -> Column:
    """Whether an n-gram lies where the first one that a linked pair shares must lie: in both shortest prefixes."""
    need = rule.need(F.col("n_x"), F.col("n_y"))
    return (F.col("pos_x") <= F.col("n_x") - need) & (F.col("pos_y") <= F.col("n_y") - need)


def _may_be_near(rule: Rule) -> Column:
    """Whether the sketches leave room for a link: they differ in no more bits than the sets may in n-grams.

    A set without a sketch may be near any other.
    """
    differ = sum((F.bit_count(F.col("odd_x")[i].bitwiseXOR(F.col("odd_y")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    return F.coalesce(differ <= F.col("n_x") + F.col("n_y") - 2 * rule.need(F.col("n_x"), F.col("n_y")), F.lit(True))


def _useful_sketch(rule: Rule) -> Column:
    """`odd`, or null for a set so large that a linked one may differ in more n-grams than sketches of unlike sets do in
    bits: half of them, and three deviations."""
    bits = 64 * SKETCH_WORDS
    unlike = bits / 2 + 3 * (bits / 4) ** 0.5
    return F.when((rule.den - rule.num) * F.col("n") < unlike * rule.den, F.col("odd")).alias("odd")


def with_earlier(rows: DataFrame, earlier: int = EARLIER) -> DataFrame:
    """`rows` (token, sid, pos, ...) with e1, e2, ...: the n-grams that come next before each one in its set's own rows."""
    own = Window.partitionBy("sid").orderBy("pos")
    return rows.select(*rows.columns, *[F.lag("token", i).over(own).alias(f"e{i}") for i in range(1, earlier + 1)])


def _earlier_match(earlier: int) -> Column:
    """Whether both sets are known to share an n-gram before this one."""
    some = F.lit(False)
    for i in range(1, earlier + 1):
        for k in range(1, earlier + 1):
            some = some | (F.col(f"e{i}_x") == F.col(f"e{k}_y"))
    return F.coalesce(some, F.lit(False))


def pairs_between(rows: DataFrame, rule: Rule, earlier: int = EARLIER) -> DataFrame:
    """sid, n and ell of x and y, for pairs of different components that the n-grams of `rows` leave in question.

    `rows` has all rows of each n-gram that several components have: token, sid, n, ell, pos, comp, major (the
    component with most rows of the n-gram), odd and the n-grams before. The first n-gram that a pair shares makes the pair, and so
    may a later one whose row shows no earlier shared one: sets that share a whole passage are few rows, not one for each of
    its n-grams. An n-gram before that both have is in `rows` under both sets, and lies where the
    later one does or before it, so none that is left out was the pair's only one.
    """
    minor = _side(rows.where("comp <> major"), "x").drop("major_x")
    return minor.join(_side(rows, "y"), "token").where(
        "comp_x <> comp_y AND (comp_y = major_y OR sid_x < sid_y)").where(
        _first_match(rule) & ~_earlier_match(earlier) & _may_be_near(rule)).select(
        *[f"{c}_{side}" for side in "xy" for c in ("sid", "n", "ell")])


def _shares_enough(rule: Rule) -> Column:
    """Whether the pair's prefixes, as long as its own l asks for, share l n-grams."""
    need = rule.need(F.col("n_x"), F.col("n_y"))
    ell = F.least(F.least("ell_x", "ell_y").cast("bigint"), need)

    def prefix(side: str) -> Column:
        return F.slice(f"tokens_{side}", F.lit(1), (F.col(f"n_{side}") - need + ell).cast("int"))

    return F.size(F.array_intersect(prefix("x"), prefix("y"))) >= ell


def _candidates(pairs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (sid_x, sid_y) that share as many prefix n-grams as their l asks for."""
    need = F.least(F.least("ell_x", "ell_y").cast("bigint"), rule.need(F.col("n_x"), F.col("n_y")))
    return (pairs.where(_matches(rule)).groupBy("sid_x", "sid_y")
            .agg(F.count("*").alias("shared"), F.max(need).alias("need")).where("shared >= need"))


def verified(pairs: DataFrame, stage: DataFrame, docs: DataFrame, rule: Rule, *, text: str = "text",
             doc_id: str = "doc_id") -> DataFrame:
    """The pairs (a, b) whose whole sets link.

    One text of each set that is in question is read again; no set travels but those of the pairs. A text is
    found by its id and its hash, so that many texts of one id, or of none, are no hot key.
    """
    pairs = lookup(pairs)
    asked = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    chosen = lookup(stage.join(lookup(asked), "sid").groupBy("sid").agg(
        F.min(F.struct("doc_id", "tie")).alias("one")).select("sid", F.col("one.doc_id").alias("__id"), F.col("one.tie").alias("__tie")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytetext.released(batches):
            data, offsets = bytetext.text_bytes(batch.column(1))
            for low, high in bytetext.slices(offsets, bytetext.FINE_BYTES):
                hashes, first, sizes, sid = _sorted_sets(
                    data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], rule.n)
                where = (np.append(first, len(hashes)) * 8).astype(np.int32)
                members = pa.BinaryArray.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(where), pa.py_buffer(hashes)])
                right = pc.equal(batch.column(0).slice(low, high - low), pa.array(sid))
                yield pa.RecordBatch.from_arrays([pa.array(sid), members], ["sid", "members"]).filter(right)

    @F.arrow_udf(T.BooleanType())
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        x, in_x = bytetext.text_bytes(left)
        y, in_y = bytetext.text_bytes(right)
        return pa.array([rule.links(x[a:b].view(np.uint64), y[c:d].view(np.uint64))
                         for a, b, c, d in zip(in_x, in_x[1:], in_y, in_y[1:])], pa.bool_())

    value = F.col(text).cast("string")
    texts = docs.select(F.col(doc_id).cast("bigint").alias("__id"), value.alias("__text"), F.xxhash64(value).alias("__tie"))
    same = texts["__id"].eqNullSafe(chosen["__id"]) & (texts["__tie"] == chosen["__tie"])
    # One Python step a task: as a column, the sets would be made once for the test of their hash and once for the result.
    found = written(texts.join(chosen, same).select("sid", "__text").mapInArrow(sets, "sid long, members binary"), "sets")
    if found.count() > chosen.count():
        # Repeated rows of one id and text.
        found = written(found.dropDuplicates(["sid"]), "sets")
    left = found.select(F.col("sid").alias("a"), F.col("members").alias("left"))
    right = found.select(F.col("sid").alias("b"), F.col("members").alias("right"))
    both = left.join(pairs, "a").join(right, "b")
    return both.where(linked("left", "right")).select("a", "b").distinct()


def set_components(stage: DataFrame, docs: DataFrame, rule: Rule, *, text: str = "text", doc_id: str = "doc_id",
                   earlier: int = 0) -> DataFrame:
    """node, root (set hashes): the components of all links between different sets.

    First, each set is compared with one other: of those that come first in the lists of its n-grams
    (the ones whose own rare n-grams are fewest), the one it meets most often. In a group of near copies
    that is its common source, so few components are left in each list. Then pairs of different
    components are made, by the n-grams that a linked pair's first shared one can be and as far as their
    sketches leave room, and those that share as many as their l asks for are compared. Pairs already connected need no comparison, so a group of
    linked copies does not cost the square of its size, and no link between components is missed.
    """
    with short_lived(docs.sparkSession) as kept:
        rows = postings(stage)
        heads = rows.groupBy("token").agg(F.min(F.struct("pos", "n", "sid", "ell")).alias("h"), F.count("*").alias("c")).where("c > 1")
        heads = heads.select("token", *[F.col(f"h.{c}").alias(f"{c}_y") for c in ("sid", "n", "ell", "pos")])
        met = _candidates(_side(rows, "x").join(heads, "token").where("sid_x <> sid_y"), rule)
        star = met.groupBy("sid_x").agg(F.max(F.struct("shared", "sid_y")).alias("best"))
        star = kept(star.select(F.least("sid_x", "best.sid_y").alias("a"), F.greatest("sid_x", "best.sid_y").alias("b")).distinct())
        first = kept(verified(star, stage, docs, rule, text=text, doc_id=doc_id))
        roots = lookup(components(first))

        placed = written(rows.join(roots, rows["sid"] == roots["node"], "left").select(
            *rows.columns, F.coalesce("root", "sid").alias("comp")), "placed")
        sizes = placed.groupBy("token", "comp").agg(F.count("*").alias("c"))
        several = sizes.groupBy("token").agg(F.max(F.struct("c", "comp"))["comp"].alias("major"), F.count("*").alias("k")).where("k > 1")
        open_rows = kept(with_earlier(placed.join(several.select("token", "major"), "token"), earlier))
    asked = lookup(open_rows.select("sid").distinct())
    own = stage.join(asked, "sid").select("sid", "n", "tokens", "odd").dropDuplicates(["sid"])
    prefix = lookup(own.select("sid", "tokens"))
    open_rows = open_rows.join(lookup(own.select("sid", _useful_sketch(rule) if earlier else "odd")), "sid")
    met = pairs_between(open_rows, rule, earlier).distinct()
    with short_lived(docs.sparkSession) as kept:
        met = written(met, "met")
        rest = met.join(_renamed(prefix, "x"), "sid_x").join(_renamed(prefix, "y"), "sid_y").where(_shares_enough(rule)).select(
            F.least("sid_x", "sid_y").alias("a"), F.greatest("sid_x", "sid_y").alias("b")).distinct()
        rest = kept(rest.join(star, ["a", "b"], "left_anti"))
    second = verified(rest, stage, docs, rule, text=text, doc_id=doc_id)
    return components(first.unionByName(second))


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), *, text: str = "text", doc_id: str = "doc_id",
                       earlier: int = 0) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, sid.

    A-Z are lower-cased, words are what lies between blanks and the controls 9 to 13, and a text of fewer
    than n words is one n-gram. Documents link by the rule; component_id is the smallest doc_id reachable
    by links. Documents without words, and null texts, have no n-grams and link with nothing: they are
    their own component. Equal sets are one set from the start, however many documents have them (`sid`
    names it). Repeated rows stay; a null id stays null and is no component's smallest unless it is alone.
    Other columns are left out.

    Sets are compared by 64-bit hashes of their n-grams; equal hashes of different n-grams are not
    expected below some 10**9 in one pair. With `earlier` n-grams a row (EARLIER, say), sets that share long
    passages make fewer rows, for more bytes a row; the result is the same.
    """
    spark = docs.sparkSession
    with short_lived(spark) as kept, arrow_rows(spark, BATCH_ROWS):
        stage = prefixes(docs, rule, text=text, doc_id=doc_id)
        roots = set_components(stage, docs, rule, text=text, doc_id=doc_id, earlier=earlier)
        ids = stage.select("doc_id", "n", "sid")
        rooted = ids.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least")).join(
            roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
        smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = lookup(rooted.join(smallest, "root").select("sid", "component_id"))
        return kept(ids.join(named, "sid", "left").select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "sid"))
