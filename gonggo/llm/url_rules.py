"""URL filters: all glob rules at once, as one bit-parallel wildcard automaton.

Every rule is a pattern of characters, `?` and `*` over the canonical URL. All patterns are laid end to
end in the bits of a few 64-bit words. A bit stands for "this much of the pattern has been read"; one
Shift-And step moves all patterns of all URLs of a batch on by one character.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

ALLOW, BLOCK = "allow", "block"

# Verdicts where no rule fits: sorts of sites to leave out, and pages that are none.
DEFAULT_GLOBS = (
    "", "*spam*", "*casino*", "*cheap-pills*", "*viagra*", "*porn*", "*xxx*", "*://*", "*/login*", "*/cart*",
)


@dataclass(frozen=True)
class Rule:
    """`target` is a host, or a host and a path from its `/` on; it also fits all subdomains."""

    verdict: str
    target: str


@dataclass
class Automaton:
    """Masks of all patterns; `within` limits a pattern's leading `*` to characters of a host."""

    patterns: list[tuple[str, bool]]
    words: int = field(init=False)

    def __post_init__(self):
        steps, loops, hosts, starts, ends = [], [], [], [], []
        for pattern, host_only in self.patterns:
            starts.append(len(steps))
            steps.append(None)
            for c in pattern.encode():
                if c == ord("*"):
                    (hosts if host_only and len(steps) - 1 == starts[-1] else loops).append(len(steps) - 1)
                else:
                    steps.append(c)
            ends.append(len(steps) - 1)
        self.words = max(1, -(-len(steps) // 64))
        self.move = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = self._bits(starts)
        self.ends = [(e // 64, np.uint64(1 << e % 64)) for e in ends]
        for bit, c in enumerate(steps):
            if c is not None:
                at = slice(None) if c == ord("?") else c
                self.move[at, bit // 64] |= np.uint64(1 << bit % 64)
        self.stay[:] = self._bits(loops)[None, :]
        self.stay[np.arange(256) != ord("/")] |= self._bits(hosts)

    def _bits(self, positions: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for p in positions:
            out[p // 64] |= np.uint64(1 << p % 64)
        return out

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """texts x patterns: which patterns fit each whole text."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        sorted_lengths = lengths[order]
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        active = len(texts)
        for i in range(int(lengths.max(initial=0))):
            while sorted_lengths[active - 1] <= i:
                active -= 1
            now, c = state[:active], data[begin[:active] + i]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.move[c]) | (now & self.stay[c])
        out = np.zeros((len(texts), len(self.patterns)), bool)
        for k, (word, bit) in enumerate(self.ends):
            out[order, k] = (state[:, word] & bit) != 0
        return out


class RuleSet:
    """Rules, longest first, then globs for what no rule fits."""

    def __init__(self, rules: list[Rule], globs: tuple[str, ...] = DEFAULT_GLOBS, otherwise: str = ALLOW):
        for rule in rules:
            if rule.verdict not in (ALLOW, BLOCK) or not rule.target or set(rule.target) & set("*?"):
                raise ValueError(f"not a rule: {rule}")
        self.rules = sorted(dict.fromkeys(rules), key=lambda r: (-len(r.target), r.target, r.verdict != BLOCK))
        self.otherwise = otherwise
        patterns = []
        for rule in self.rules:
            host, slash, path = rule.target.partition("/")
            host = "".join(c.lower() if c.isascii() else c for c in host)
            # "." before the host stands for its start, so that "org" is no end of "notorg".
            patterns.append((f"*.{host}{slash}{path}*" if slash else f"*.{host}", True))
            if not slash:
                patterns.append((f"*.{host}/*", True))
        self.owner = [i for i, r in enumerate(self.rules) for _ in range(1 if "/" in r.target else 2)]
        self.automaton = Automaton(patterns + [(f".{g}" if not g.startswith("*") else g, False) for g in globs])

    def judge(self, canonical: list[bytes]) -> list[dict]:
        fits = self.automaton.matches(canonical)
        by_rule = fits[:, :len(self.owner)]
        first = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1), -1) if self.owner else np.full(len(canonical), -1)
        blocked = fits[:, len(self.owner):].any(axis=1)
        other = BLOCK if self.otherwise == ALLOW else ALLOW
        out = []
        for k, b in zip(first.tolist(), blocked.tolist()):
            rule = self.rules[self.owner[k]] if k >= 0 else None
            out.append({"rule": rule.target if rule else None,
                        "verdict": rule.verdict if rule else other if b else self.otherwise})
        return out


_TYPE = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
_ARROW_TYPE = pa.struct([("rule", pa.string()), ("verdict", pa.string())])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: RuleSet, *, url: str = "url", out: str = "judgement") -> DataFrame:
    """`pages` plus a struct column `out`: host, path, rule and verdict of each URL.

    The canonical URL is the lower-cased host and the path. A rule fits its host and all subdomains if
    the path starts with the rule's; the longest fitting rule decides. Where none fits, a URL that any
    of the rule set's globs matches gets the verdict against `otherwise`, all others get `otherwise`.
    Null URLs and those without `://` have an empty host and path, which the glob "" matches.

    Masks travel with the function: 4 KB per 64 pattern characters. Batches of URLs are read a
    character at a time, the longest URLs last, without any shuffle. A column named `out` is
    replaced; all others are kept.
    """
    @F.arrow_udf(_TYPE)
    def judge(host: pa.Array, path: pa.Array) -> pa.Array:
        canonical = [f".{h}{p}".encode() for h, p in zip(host.to_pylist(), path.to_pylist())]
        return pa.array(rules.judge(canonical), type=_ARROW_TYPE)

    column = F.col(url).cast("string")
    host, path = host_of(column), path_of(column)
    verdict = judge(host, path)
    return pages.withColumn(out, verdict).withColumn(out, F.struct(
        host.alias("host"), path.alias("path"), F.col(out)["rule"].alias("rule"),
        F.col(out)["verdict"].alias("verdict")))
