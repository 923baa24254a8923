"""Token counts by a two-tier lookup of words and pre-tokens on the map side."""

from __future__ import annotations

import codecs
import json
import re
import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gonggo.llm import bytetext

# The published splitting pattern of byte-level BPE vocabularies (fixed value).
PRE_TOKENS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Its blanks (Unicode white space; Python's own `\s` has four more), and runs of whole pre-tokens: words with all that
# is written onto them. No pre-token crosses the end of one, and the pattern finds the same in a run as in its text.
BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = f" ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
# The character that stands for each byte in such vocabularies (fixed value): itself where it prints.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
BYTE_LETTERS = "".join(_OTHERS.get(b, chr(b)) for b in range(256))

# Broadcast table: entries, bytes of one word, rows looked at to find frequent ones.
TABLE_SIZE, TABLE_WORD_BYTES, TABLE_ROWS = 100_000, 40, 4_000
# Entries of a worker's own cache before it starts anew.
CACHE_SIZE = 400_000


def byte_level(path: str) -> bool:
    """Whether the file is a byte-level BPE whose pre-tokens are encoded on their own."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and spec["model"]["type"] == "BPE"
            and not spec["model"].get("ignore_merges") and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space") and bool(split.get("use_regex", True)))


def _plain_counter(path: str):
    """Counts of whole texts by the vocabulary's own library, its special strings, and its model (.json only)."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text)), [], None
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    special = [t.content for t in model.get_added_tokens_decoder().values()]
    return lambda text: len(model.encode(text, add_special_tokens=False)), special, model.model


_PARTS = regex.compile(PRE_TOKENS).findall


def parts_of(word: str) -> list[str]:
    """The pre-tokens of one word; letters, or letters and what ASCII marks follow, need no pattern."""
    letters = word.rstrip(string.punctuation)
    if letters.removeprefix(" ").isalpha():
        return [letters, word[len(letters):]] if len(letters) < len(word) else [word]
    return _PARTS(word)


class Lengths(dict):
    """Word or pre-token -> number of tokens: the frequent ones, then the pre-tokens that this worker has met."""

    def __init__(self, frequent: dict[str, int], model):
        super().__init__(frequent)
        self.frequent, self.model, self.most = frequent, model, len(frequent) + CACHE_SIZE

    def __missing__(self, word: str) -> int:
        total = 0
        for part in parts_of(word):
            n = self.get(part)
            if n is None:
                n = len(self.model.tokenize(codecs.charmap_decode(part.encode(), "strict", BYTE_LETTERS)[0]))
                if len(part) <= 4 * TABLE_WORD_BYTES:
                    if len(self) >= self.most:
                        self.clear()
                        self.update(self.frequent)
                    self[part] = n
            total += n
        return total


class TextCounter:
    """Counts tokens of whole texts; special strings in a text go through the library itself."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        self.encode, special, model = _plain_counter(path)
        self.split = re.compile(WORDS).findall if byte_level(path) else None
        if self.split:
            self.special = regex.compile("|".join(map(regex.escape, special))).search if special else None
            self.lengths = Lengths(frequent or {}, model)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.split or (self.special and self.special(text)):
            return self.encode(text)
        return sum(map(self.lengths.__getitem__, self.split(text)))


def unpack(table: tuple[str, bytes]) -> dict[str, int]:
    joined, lengths = table
    return dict(zip(joined.split("\0"), lengths)) if lengths else {}


def _counter(path: str, table: Broadcast) -> TextCounter:
    """The worker's counter, kept on its copy of the broadcast table.

    With what it has met it takes 100 MB and more, and the worker lives on through other jobs: it goes with that
    copy, which the worker drops at its first task without the table.
    """
    own = vars(table).setdefault("counters", {})
    if path not in own:
        own[path] = TextCounter(path, unpack(table.value))
    return own[path]


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", size: int = TABLE_SIZE,
                     rows: int = TABLE_ROWS) -> tuple[str, bytes]:
    """The most frequent words of about `rows` texts, joined by NUL, and their token counts.

    Words are counted where the chosen texts lie; eight tasks send the driver at most `size`
    entries each. It only decides which lengths are at hand: results do not depend on it.
    """
    if not byte_level(path):
        return "", b""
    share = min(1.0, rows / max(docs.count(), 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found = re.compile(WORDS).findall, Counter()
        for batch in bytetext.released(batches):
            for value in batch.column(0).to_pylist():
                found.update(w for w in split(value or "")
                             if len(w.encode()) <= TABLE_WORD_BYTES and "\0" not in w)
                if len(found) > 4 * size:
                    found = Counter(dict(found.most_common(2 * size)))
        top = found.most_common(size)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()),
                                          pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    chosen = docs.select(F.col(text).cast("string").alias("text")).sample(share, seed=7).repartition(8)
    total: Counter = Counter()
    for row in chosen.mapInArrow(count, "word string, n long").toLocalIterator():
        total[row.word] += row.n
    lengths = TextCounter(path).lengths
    table = [(w, lengths[w]) for w, n in total.most_common(size) if n > 1]
    table = [(w, n) for w, n in table if n < 256]
    return "\0".join(w for w, _ in table), bytes(n for _, n in table)


def count_tokens(text: Column, path: str, table: Broadcast) -> Column:
    """Tokens of each whole text; `path` is a vocabulary file at the same place on every worker."""
    @F.arrow_udf(T.LongType())
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(path, table)
        for column in bytetext.released(columns):
            yield pa.array([counter(value.as_py()) for value in column], pa.int64())

    return count(text.cast("string"))


def with_token_counts(docs: DataFrame, path: str, *, text: str = "text", out: str = "n_tokens",
                      table_size: int = TABLE_SIZE, table_rows: int = TABLE_ROWS) -> DataFrame:
    """`docs` plus the number of tokens of each text, without begin, end or added special tokens.

    For byte-level vocabularies, texts are split into words in place, without a shuffle. Lengths
    come from a broadcast table of at most `table_size` frequent words. Other words are split into their
    pre-tokens, whose lengths come from a cache in each worker; it has the vocabulary's model encode
    what it has not met, and starts anew at its bound. Pre-tokens of any length are encoded whole. Special
    strings inside a text count as the library's default has them. Other vocabularies (.json, .model) are
    counted text by text by their library.

    A null or empty text has 0 tokens; a column named `out` is replaced; nothing is truncated.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text, table_size, table_rows))
    return docs.withColumn(out, count_tokens(F.col(text), path, table))
