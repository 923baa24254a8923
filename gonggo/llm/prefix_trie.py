"""Prefix tries of conversations, as double arrays.

Conversations are sorted by their sequences of turn digests. A shard is a run of that order, whatever its
prefixes are, so that one very common beginning spreads over shards. In a shard, turns get dense ids, and the
trie is packed into BASE and CHECK: the child of node s by turn t is node BASE[s] + t, if its CHECK is s.
Only nodes on a shard's first and last path can lie in other shards as well. How far they do follows from
the neighbours' longest common prefixes; those nodes come out as partial figures that add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gonggo.functions.joins import small_side
from gonggo.session import written

# Turns of one shard, conversations of one packed list of ids, turn numbers of one block.
SHARD_TURNS, LIST_IDS, BLOCK_TURNS = 1 << 16, 4096, 256
DIGEST = 16
# Places that a node's children try before they go behind all others.
TRIED = 256
NOTHING = hashlib.sha256(b"").hexdigest()

_FREE, _TOP = -1, -2
_SEQUENCES = "path binary, chars array<int>, n long, least long, ends string"
_NODES = ("node binary, depth long, conv_id long, parent binary, parent_conv_id long, n_convs long, n_children long, "
          "n_leaves long, saved_tokens long, ends string")


def sequences(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """conv_id, path (the digests of its turns, in order, as hex) and chars (the code points of their texts).

    A null role or text is empty. Turns go by number, null first, and by digest where that is equal. Rows
    without a conversation id are left out. Digests tell turns apart from here on; no text is shuffled.
    """
    said = F.coalesce(F.col(role).cast("string"), F.lit(""))
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"), F.floor(F.col(turn).cast("bigint") / BLOCK_TURNS).alias("block"),
        F.struct(F.col(turn).cast("bigint").alias("turn"),
                 F.md5(F.concat(F.length(said).cast("string"), F.lit(":"), said, words)).alias("digest"),
                 F.length(words).alias("chars")).alias("t"))
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.struct("block", F.array_join(F.col("t.digest"), "").alias("path"), F.col("t.chars").alias("chars")).alias("b"))
    return blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("b")).select(
        "conv_id", F.array_join(F.col("b.path"), "").alias("path"), F.flatten(F.col("b.chars")).alias("chars"))


def headed(own: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """`own` with the first `heads` (up to `most`) turns of the conversation `base` in place of its own first ones."""
    given = own.withColumns({"__base": base, "__h": heads.cast("int")})
    first = own.select(F.col("conv_id").alias("__base"), F.substring("path", 1, 2 * DIGEST * most).alias("__path"),
                       F.slice("chars", 1, most).alias("__chars"))
    cut = F.col("__h") * 2 * DIGEST
    return given.join(first, "__base", "left").select(
        "conv_id",
        F.concat(F.coalesce(F.substr("__path", F.lit(1), cut), F.lit("")), F.substr("path", cut + 1)).alias("path"),
        F.concat(F.coalesce(F.slice("__chars", F.lit(1), F.col("__h")), F.array().cast("array<int>")),
                 F.slice("chars", F.col("__h") + 1, F.greatest(F.size("chars"), F.lit(1)))).alias("chars"))


def _distinct(rows: DataFrame) -> DataFrame:
    """The distinct sequences: path, chars, how many conversations have it, the smallest one, and the digest
    of all their ids, ascending.

    Ids are first joined per `LIST_IDS` numbers, and these lists are hashed one after the other, so the
    copies of a very common conversation meet as few short rows.
    """
    lists = rows.withColumns({"seq": F.unhex(F.md5("path")), "at": F.floor(F.col("conv_id") / LIST_IDS)}).groupBy("seq", "at").agg(
        F.first("path").alias("path"), F.first("chars").alias("chars"), F.count("*").alias("n"),
        F.min("conv_id").alias("least"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, row, total, state, out = None, None, 0, None, []
        for batch in batches:
            for s, _, path, chars, n, least, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if s != seq:
                    if row:
                        out.append((*row[:2], total, row[2], state.hexdigest()))
                    seq, row, total, state = s, (bytes.fromhex(path), chars, least), n, hashlib.sha256(ids.encode())
                else:
                    total += n
                    state.update(b"," + ids.encode())
            if out:
                yield _rows(out, ["path", "chars", "n", "least", "ends"], [pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()])
                out = []
        if row:
            yield _rows([(*row[:2], total, row[2], state.hexdigest())], ["path", "chars", "n", "least", "ends"],
                        [pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()])

    packed = lists.select("seq", "at", "path", "chars", "n", "least", "ids")
    return packed.repartition("seq").sortWithinPartitions("seq", "at").mapInArrow(joined, _SEQUENCES)


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


@dataclass
class DoubleArray:
    """BASE and CHECK over dense turn ids; node 0 is the root."""

    base: np.ndarray
    check: np.ndarray

    @classmethod
    def packed(cls, tokens: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> "DoubleArray":
        """The trie of sorted sequences (`tokens` from `begin`, `sizes` of them), level by level.

        An only child goes to any free place; several children to the first base whose places are all free.
        """
        trie = cls(np.zeros(1, np.int64), np.full(1, _TOP, np.int64))
        state = np.zeros(len(begin), np.int64)
        for d in range(int(sizes.max(initial=0))):
            going = np.flatnonzero(sizes > d)
            pairs = np.stack([state[going], tokens[begin[going] + d]], axis=1)
            children, of = np.unique(pairs, axis=0, return_inverse=True)
            first = np.flatnonzero(np.append(True, children[1:, 0] != children[:-1, 0]))
            count = np.diff(np.append(first, len(children)))
            for at, n in zip(first[count > 1], count[count > 1]):
                trie._place(children[at, 0], children[at:at + n, 1])
            trie._place_only(children[first[count == 1]])
            state[going] = (trie.base[children[:, 0]] + children[:, 1])[of.ravel()]
        return trie

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, _FREE, np.int64)])

    def _place(self, node: int, tokens: np.ndarray) -> None:
        away = tokens - tokens[0]
        free = np.flatnonzero(self.check == _FREE)[:TRIED]
        free = free[free + away[-1] < len(self.check)]
        fits = (self.check[free[:, None] + away] == _FREE).all(axis=1)
        at = int(free[fits][0]) if fits.any() else int(np.flatnonzero(self.check != _FREE)[-1]) + 1
        self._grow(at + int(away[-1]) + 1)
        self.base[node] = at - tokens[0]
        self.check[at + away] = node

    def _place_only(self, children: np.ndarray) -> None:
        free = np.flatnonzero(self.check == _FREE)
        if len(free) < len(children):
            self._grow(len(self.check) + len(children))
            free = np.flatnonzero(self.check == _FREE)
        free = free[:len(children)]
        self.base[children[:, 0]] = free - children[:, 1]
        self.check[free] = children[:, 0]

    def step(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The children of the states by the tokens."""
        to = self.base[states] + tokens
        if (self.check[to] != states).any():
            raise ValueError("a sequence is not in this trie")
        return to


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their beginnings."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) // DIGEST


def _digests(path: bytes, depth: int) -> list[bytes]:
    """The names of the first nodes on a path, from the root to `depth`."""
    state, out = hashlib.md5(), [hashlib.md5().digest()]
    for d in range(depth):
        state.update(path[d * DIGEST:(d + 1) * DIGEST])
        out.append(state.digest())
    return out


def _shard_nodes(rows: list[tuple], before: int, behind: int) -> pa.RecordBatch:
    """The nodes of one shard, given as sorted sequences.

    `before` and `behind`: turns in common with the sequence before and behind the shard, -1 without one.
    """
    paths, chars, n, least, ends = zip(*rows)
    sizes = np.array([len(c) for c in chars], np.int64)
    begin = np.cumsum(sizes) - sizes
    _, tokens = np.unique(np.frombuffer(b"".join(paths), f"S{DIGEST}"), return_inverse=True)
    tokens = tokens.ravel() + 1
    length = np.concatenate([np.asarray(c, np.int64) for c in chars])
    trie = DoubleArray.packed(tokens, begin, sizes)
    size = len(trie.check)
    convs, conv, depth, last = (np.zeros(size, np.int64) for _ in range(4))
    conv[:] = np.iinfo(np.int64).max
    n, least = np.array(n, np.int64), np.array(least, np.int64)
    state, going = np.zeros(len(rows), np.int64), np.arange(len(rows))
    convs[0], conv[0] = n.sum(), least.min()
    shared, owned = np.zeros(size, bool), np.ones(size, bool)
    shared[0], owned[0] = before >= 0 or behind >= 0, before < 0
    for d in range(int(sizes.max(initial=0))):
        going = going[sizes[going] > d]
        at = begin[going] + d
        state[going] = to = trie.step(state[going], tokens[at])
        np.add.at(convs, to, n[going])
        np.minimum.at(conv, to, least[going])
        depth[to], last[to] = d + 1, length[at]
        if d < before and going[0] == 0:
            shared[to[0]], owned[to[0]] = True, False
        if d < behind and going[-1] == len(rows) - 1:
            shared[to[-1]] = True
    used = np.flatnonzero(trie.check != _FREE)
    parent = trie.check
    children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), (convs - owned) * last
    below = used[used > 0]
    local = np.bincount(parent[below], minlength=size)
    np.add.at(children, parent[below], owned[below])
    leaves[used] = local[used] == 0
    if sizes[-1] == behind:
        leaves[state[-1]] = False
    order = below[np.argsort(-depth[below], kind="stable")]
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []:
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    end = {int(s): e for s, e in zip(state, ends)}
    names = {}
    for row, reach in ((0, before), (-1, behind)):
        steps, at = [0], 0
        for d in range(min(reach, int(sizes[row]))):
            at = int(trie.base[at] + tokens[begin[row] + d])
            steps.append(at)
        if reach >= 0:
            names.update(zip(steps, _digests(paths[row], len(steps) - 1)))
    over = [None if s == 0 else names.get(int(parent[s])) for s in used]
    return pa.RecordBatch.from_arrays([
        pa.array([names.get(int(s)) for s in used], pa.binary()), pa.array(depth[used]), pa.array(conv[used]),
        pa.array(over, pa.binary()),
        pa.array(conv[np.maximum(parent[used], 0)], mask=(used == 0) | np.array([o is not None for o in over], bool)),
        pa.array(convs[used]), pa.array(children[used]), pa.array(leaves[used]), pa.array(saved[used]),
        pa.array([end.get(int(s)) for s in used], pa.string())],
        ["node", "depth", "conv_id", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"])


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of sorted sequences, cut at `SHARD_TURNS` turns, one after the other."""
    part, held, turns, before, behind = None, [], 0, -1, -1
    for batch in batches:
        for own, ahead, beyond, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (own != part or turns >= SHARD_TURNS):
                near = _common(held[-1][0], row[0]) if own == part else behind
                yield _shard_nodes(held, before, near)
                held, turns, before = [], 0, near
            if own != part:
                part, before, behind = own, ahead, beyond
            held.append(tuple(row))
            turns += len(row[1]) + 1
    if held:
        yield _shard_nodes(held, before, behind)


def _neighbours(stage: DataFrame) -> DataFrame:
    """For each part: the turns its first and last sequence have in common with the parts beside it."""
    @F.arrow_udf("int")
    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([-1 if x is None or y is None else _common(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    edges = stage.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("part")
    return edges.select("part", "first", "last", F.lag("last").over(order).alias("ahead"), F.lead("first").over(order).alias("beyond")).select(
        "part", common("ahead", "first").alias("before"), common("last", "beyond").alias("behind"))


def trie_nodes(rows: DataFrame) -> DataFrame:
    """One row per distinct beginning of the conversations in `rows` (conv_id once, path and chars as by
    `sequences`): conv_id (the smallest of its members), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    The root has depth 0 and no parent. n_leaves and saved_tokens are sums over the node's subtree: nodes
    without children, and (n_convs - 1) times the code points of the node's last text. ends_sha256 covers
    the ids of the conversations that end at the node, ascending, with commas between. Conversations
    without turns end at the root; without any conversation there are no rows.

    Sequences are sorted over `spark.sql.shuffle.partitions` parts, and a task holds one shard of
    `SHARD_TURNS` turns (or one longer conversation, 20 bytes a turn).
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = written(_distinct(rows), "sequences")
    stage = written(once.repartitionByRange(n, "path").withColumn("part", F.spark_partition_id()), "ranges")
    placed = stage.join(F.broadcast(_neighbours(stage)), "part").select("part", "before", "behind", "path", "chars", "n", "least", "ends")
    nodes = written(placed.repartition(n, "part").sortWithinPartitions("part", "path").mapInArrow(_tries, _NODES), "nodes")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = nodes.where("node IS NOT NULL").groupBy("node").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"),
        F.max("parent_conv_id").alias("parent_conv_id"), *sums, F.max("ends").alias("ends"))
    upper = small_side(merged)
    names = upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("__over"))
    every = nodes.where("node IS NULL").unionByName(upper).join(names, "parent", "left")
    return every.select("conv_id", "depth", F.coalesce("__over", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children",
                        "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))
