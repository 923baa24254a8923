"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted, adjacent turns of one role merge, and the conversation
becomes one string with a loss mask. The string can be read back without loss.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gonggo.functions.stages import computed

# Turns of one conversation that are merged in one step; longer ones are merged block by block.
BLOCK_TURNS = 256

_RUNS = "array<struct<role:string,texts:array<string>>>"
_MASK = "array<struct<chars:bigint,loss:boolean>>"


@dataclass(frozen=True)
class Template:
    """`start` role `body` text [`join` text ...] `end`, for each run of turns of one role.

    Where a control string occurs in a role or text, a backslash goes in after its first character
    (one more, if backslashes are there already), and reading back takes one out. So no control string
    is left in an escaped text, and every text comes back as it was.
    """

    start: str = "<|turn|>"
    body: str = "<|text|>"
    join: str = "<|more|>"
    end: str = "<|end|>"
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        heads = {c[:1] for c in self.controls}
        if len(set(self.markers)) < 4 or any(len(c) < 2 or set(c[1:]) & heads or "\\" in c for c in self.controls):
            raise ValueError("control strings need a first character that none has further on, and no backslash")

    @property
    def markers(self) -> tuple[str, ...]:
        return self.start, self.body, self.join, self.end

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.markers + self.others))

    def _places(self, between: str) -> str:
        heads = dict.fromkeys(c[0] for c in self.controls)
        return "|".join(rf"(?<=\Q{h}\E){between}(?=\\*(?:" + "|".join(
            rf"\Q{c[1:]}\E" for c in self.controls if c[0] == h) + "))" for h in heads)

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._places("")), F.lit(r"\\"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._places(r"\\")), F.lit(""))


def _quoted(*parts: str) -> str:
    return "|".join(rf"\Q{p}\E" for p in parts)


def _last(runs: Column) -> Column:
    return F.get(runs, F.size(runs) - 1)


def _joined(left: Column, right: Column) -> Column:
    """Two lists of runs as one; the last and first run become one if their role is the same."""
    first = F.get(right, F.lit(0))
    run = F.struct(first["role"].alias("role"), F.concat(_last(left)["texts"], first["texts"]).alias("texts"))
    return F.when(_last(left)["role"] == first["role"], F.concat(
        F.slice(left, F.lit(1), F.size(left) - 1), F.array(run),
        F.slice(right, F.lit(2), F.greatest(F.size(right) - 1, F.lit(0))))).otherwise(F.concat(left, right))


def formatted(turns: DataFrame, template: Template = Template(), *, conv: str = "conv_id", turn: str = "turn",
              role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: `conv`, formatted, loss_mask.

    `loss_mask` covers the string piece by piece, in order: the code points of each marker, role and
    text, and whether they count for the loss (texts of the template's loss roles).

    Turns are sorted by turn, role and text, so ties and repeated rows have a fixed order and all stay.
    A null role or text is empty, a null turn comes first, and turns without a conversation id make
    one conversation without id. Rows are first collected per `BLOCK_TURNS` turn numbers, and the merged
    blocks per conversation, so a very long conversation is merged by many tasks; only its finished runs
    meet. Other columns are left out.
    """
    rows = turns.select(
        F.col(conv).alias("__conv"), F.floor(F.col(turn).cast("bigint") / BLOCK_TURNS).alias("__block"),
        F.struct(F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("__turn"))
    blocks = rows.groupBy("__conv", "__block").agg(F.sort_array(F.collect_list("__turn")).alias("__turns"))
    merged = blocks.select("__conv", F.struct("__block", F.aggregate(
        "__turns", F.array().cast(_RUNS), lambda runs, t: _joined(
            runs, F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))))).alias("runs")).alias("__b"))
    whole = merged.groupBy("__conv").agg(F.sort_array(F.collect_list("__b")).alias("__blocks"))
    runs = computed(whole, F.transform(
        F.aggregate("__blocks", F.array().cast(_RUNS), lambda left, b: _joined(left, b["runs"])),
        lambda r: F.struct(template.escape(r["role"]).alias("role"), r["role"].isin(*template.loss_roles).alias("loss"),
                           F.transform(r["texts"], template.escape).alias("texts"))).alias("__runs"), keep=("__conv",))

    def piece(chars: Column, loss: Column) -> Column:
        return F.struct(chars.cast("bigint").alias("chars"), loss.alias("loss"))

    def fixed(marker: str) -> Column:
        return piece(F.lit(len(marker)), F.lit(False))

    def pieces(r: Column) -> Column:
        texts = F.flatten(F.transform(r["texts"], lambda t, i: F.concat(
            F.when(i > 0, F.array(fixed(template.join))).otherwise(F.array().cast(_MASK)),
            F.array(piece(F.length(t), r["loss"])))))
        return F.concat(F.array(fixed(template.start), piece(F.length(r["role"]), F.lit(False)), fixed(template.body)),
                        texts, F.array(fixed(template.end)))

    return runs.select(
        F.col("__conv").alias(conv),
        F.array_join(F.transform("__runs", lambda r: F.concat(
            F.lit(template.start), r["role"], F.lit(template.body),
            F.array_join(r["texts"], template.join), F.lit(template.end))), "").alias("formatted"),
        F.filter(F.flatten(F.transform("__runs", pieces)), lambda p: p["chars"] > 0).alias("loss_mask"))


def turns_read(text: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation: an array of role and text, in order."""
    runs = F.filter(F.split(text, _quoted(template.start)), lambda x: x != "")

    def texts(run: Column) -> Column:
        parts = F.split(run, _quoted(template.body, template.end))
        return F.transform(F.split(F.get(parts, F.lit(1)), _quoted(template.join)), lambda t: F.struct(
            template.unescape(F.get(parts, F.lit(0))).alias("role"), template.unescape(t).alias("text")))

    return F.flatten(F.transform(runs, texts))


def loss_text(text: Column, mask: Column, template: Template = Template()) -> Column:
    """All of a formatted conversation that lies under its loss mask, unescaped and joined."""
    markers = _quoted(*template.markers)
    tokens = F.filter(F.split(text, f"(?<={markers})|(?={markers})"), lambda x: x != "")
    sized = F.zip_with(tokens, mask, lambda t, m: F.struct(
        t.alias("text"), F.when(F.length(t) == m["chars"], m["loss"]).alias("loss")))
    fits = F.forall(sized, lambda s: s["loss"].isNotNull())
    kept = F.transform(F.filter(sized, lambda s: s["loss"]), lambda s: template.unescape(s["text"]))
    return F.when(fits, F.array_join(kept, "")).otherwise(F.raise_error(F.lit("the loss mask does not fit the text")))
