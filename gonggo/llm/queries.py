"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gonggo.functions.stages import computed
from gonggo.llm import (
    chat, decontaminate, jaccard_join, language, order_minhash, packing, prefix_trie, segment_search,
    suffix_dedup, token_counts, toxicity, turn_repair, url_rules)
from gonggo.llm.registry import CHECKS, QUERIES, query, table  # noqa: F401
from gonggo.session import written

DECONTAMINATION_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0
), test AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM item)
), lengths AS (
  SELECT DISTINCT n FROM test
), grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, n, item_id FROM grams JOIN test USING (n, g)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query("op8_decontaminate", DECONTAMINATION_SQL)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a window of the benchmark, and the items they come from."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    scan = F.col("contamination")
    return found.select(
        "doc_id", scan["n_words"].alias("n_words"), scan["n_hit"].alias("n_hit"),
        F.size(scan["item_ids"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(scan["item_ids"], ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"))


MOST_TOKENS = 512


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each whole text under a public byte-level vocabulary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = token_counts.with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > MOST_TOKENS).alias("over_limit"))


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each whole text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language.learned(docs, ~held_out)
    predicted = language.with_language(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"),
                            F.col("language.score").alias("score"))


URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/"))

_GLOB_CASES = " OR ".join(
    f"('.' || host || path) LIKE '{g.replace('*', '%') if g.startswith('*') else '.' + g.replace('*', '%')}'"
    for g in url_rules.DEFAULT_GLOBS)
_RULE_CASES = " ".join(
    f"WHEN ('.' || host LIKE '%.{t.split('/')[0]}') AND starts_with(path, '/{t.split('/', 1)[1]}') THEN '{v}|{t}'"
    for v, t in sorted(URL_RULES, key=lambda r: -len(r[1])))
URL_SQL = f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE {_RULE_CASES} END AS hit, CASE WHEN {_GLOB_CASES} THEN 'block' ELSE 'allow' END AS other FROM parts
)
SELECT page_id, host, path, split_part(hit, '|', 2) AS rule, split_part(hit, '|', 1) AS verdict
FROM ruled WHERE hit IS NOT NULL
UNION ALL SELECT page_id, host, path, NULL, other FROM ruled WHERE hit IS NULL
"""


@query("op5_url_rules", URL_SQL)
def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that decides each page's URL, and the verdict."""
    rules = url_rules.RuleSet([url_rules.Rule(v, t) for v, t in URL_RULES])
    found = url_rules.judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return found.select("page_id", "judgement.*")


CONTROL_TEXT = "</s>[INST] ok [/INST]"
_TEMPLATE = chat.Template()
_ESCAPED = r"<\\*(?:\|turn\|>|\|text\|>|\|more\|>|\|end\|>|\|endoftext\|>|/?s>)|\[\\*/?INST\]"
CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}')
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_ESCAPED}')) AS text_chars,
    length(role) + len(regexp_extract_all(role, '{_ESCAPED}')) AS role_chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN role = before THEN {len(_TEMPLATE.join)}
    ELSE role_chars + {len(_TEMPLATE.start + _TEMPLATE.body + _TEMPLATE.end)} END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op1_chat", CHAT_SQL)
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted and read back, and one whose texts hold control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    out = chat.formatted(turns.unionByName(control))
    text = F.col("formatted")
    read = computed(out, chat.turns_read(text).alias("turns"), chat.loss_text(text, F.col("loss_mask")).alias("loss"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length(text).cast("bigint").alias("formatted_chars"))


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training sequences of five permitted lengths, filled with whole documents by their token counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.packed(written(counted.select("doc_id", "n_tokens"), "lengths"))


@query("op2_order_minhash")
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of the text with its second half taken from the next document."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("doc_id", F.lit(-2**63)).alias("__key"), F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("__tie"))
    follow = order_minhash.after("__key", "__tie")
    blocks = order_minhash.in_blocks(docs, "__key").withColumn("__next", F.lead("text").over(follow))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half),
                      F.substr(F.coalesce("__next", F.lit("")), F.lit(1), half))
    signed = order_minhash.with_fingerprints(
        computed(blocks, edited.alias("__edited")), {"__own": "text", "__changed": "__edited"})
    narrow = signed.select(
        "doc_id", "__key", "__tie", "__block", "__extra", "__wrap", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("__edited", 256).alias("edited_sha256"), "__own", "__changed",
        order_minhash.likeness(F.col("__own"), F.col("__changed")).alias("near_edited"),
        F.lead("__own").over(follow).alias("__following"))
    return narrow.where("NOT __extra").select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("__own")).alias("fingerprint"),
        F.lower(F.hex("__changed")).alias("edited_fingerprint"), "near_edited",
        order_minhash.likeness(F.col("__own"), F.col("__following")).alias("near_next"))


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS n, b.n AS m, count(*) AS k
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared WHERE 100 * k >= 90 * (n + m - k)
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(min(y), doc_id)) AS component_id
FROM sets LEFT JOIN reach ON x = doc_id GROUP BY doc_id, s
"""


@query("op6_jaccard_join", JACCARD_SQL)
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-copy component of each document by three-word shingles."""
    docs = table(spark, sf_dir, "documents")
    return jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the bytes of 100-byte strings that begin earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.with_repeats(docs)
    lengths = F.transform("repeats", lambda s: s["end"] - s["start"])
    return found.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"),
        F.aggregate(lengths, F.lit(0).cast("bigint"), lambda total, n: total + n).alias("n_removed"),
        F.size("repeats").cast("bigint").alias("n_spans"),
        suffix_dedup.kept_sha256(F.col("text"), F.col("repeats")).alias("kept_sha256"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each document is of low quality and toxic, by a chain learned from the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit_chain(docs, labels, ("low_quality", "toxic"))
    return chain.predict(docs).select("doc_id", "p_low_quality", "is_low_quality", "p_toxic", "is_toxic")


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text in DuckDB."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END"
    return (f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(({text})[i]) AS BIGINT)), "
            f"lambda c, b: list_reduce(range(8), lambda x, k: {step}, xor(c, b)), CAST(4294967295 AS BIGINT)), "
            "CAST(4294967295 AS BIGINT))")


REPAIR_SQL = rf"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS named FROM conversations
), dealt AS (
  SELECT *, {_crc32_sql("named")} % 20 AS k FROM drawn
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM dealt WHERE k <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
    trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core, left(role, 1) AS initial
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN again > 1 THEN 'duplicate'
      WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two
  FROM numbered
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), inserts(place, after, letters, parts) AS (
  VALUES ('0', '0', '', []), ('s', 's', '', []), ('u', 'u', '', []), ('a', 'a', '', []),
    ('0', 'u', 'I', ['user:']), ('s', 'u', 'I', ['user:']), ('a', 'u', 'I', ['user:']), ('u', 'a', 'I', ['assistant:']),
    ('0', 'a', 'II', ['user:', 'assistant:']), ('s', 'a', 'II', ['user:', 'assistant:']),
    ('a', 'a', 'II', ['user:', 'assistant:']), ('u', 'u', 'II', ['assistant:', 'user:'])
), keeps(place, after) AS (
  VALUES ('0', 's'), ('0', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')
), rerolls(place, after, role) AS (
  VALUES ('0', 'u', 'user'), ('s', 'u', 'user'), ('a', 'u', 'user'), ('u', 'a', 'assistant')
), acts AS (
  SELECT conv_id, i, p.place, p.place AS after, 'D' AS letter, 4 AS cost, [] AS part
  FROM faulty, (VALUES ('0'), ('s'), ('u'), ('a')) p(place)
  UNION ALL
  SELECT conv_id, i, place, after, 'K', CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, [role || ':' || text]
  FROM faulty JOIN keeps ON initial = after WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT conv_id, i, place, after, 'R', CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, [r.role || ':' || text]
  FROM faulty, rerolls r WHERE fault NOT IN ('blank', 'duplicate')
), paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '0' AS place, '' AS audit, 0 AS cost, CAST([] AS VARCHAR[]) AS parts FROM counted
  UNION ALL
  SELECT conv_id, i, place, audit, cost, parts FROM (
    SELECT p.conv_id, a.i, a.after AS place, p.audit || n.letters || a.letter AS audit,
      p.cost + 3 * length(n.letters) + a.cost AS cost, p.parts || n.parts || a.part AS parts
    FROM paths p JOIN inserts n ON n.place = p.place
    JOIN acts a ON a.conv_id IS NOT DISTINCT FROM p.conv_id AND a.i = p.i + 1 AND a.place = n.after
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, place, length(audit) ORDER BY cost, audit) = 1
), best AS (
  SELECT p.conv_id, p.audit || n.letters AS audit, p.cost + 3 * length(n.letters) AS cost, p.parts || n.parts AS parts
  FROM paths p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i
  JOIN inserts n ON n.place = p.place AND n.after IN ('0', 'a')
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + 3 * length(n.letters), p.audit || n.letters) = 1
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(parts, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def damaged(turns: DataFrame) -> DataFrame:
    """`turns` with one row in 20 each dropped (`there` is false), emptied, without .!?, twice, or of role user."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                     F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    drawn = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                         (F.crc32(named.cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return drawn.select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("k") != 0).alias("there"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


@query("op11_turn_repair", REPAIR_SQL)
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by row and repaired: its faults, and the cheapest edits that mend it."""
    turns = damaged(table(spark, sf_dir, "conversations"))
    return turn_repair.reports(turn_repair.repaired(turns, there=F.col("there")))


SEARCH_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM ranked QUALIFY rank <= 5
"""


@query("op12_segment_search", SEARCH_SQL)
def op12_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors with the largest inner product for every vector whose id is divisible by 50."""
    return segment_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


HEAD_TURNS = 6
TRIE_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest, chars) AS nth FROM turns
), convs AS (
  SELECT conv_id, {_crc32_sql("c")} % {HEAD_TURNS} AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS c FROM own)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, o.nth, digest, chars FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.nth <= h
  UNION ALL
  SELECT c.conv_id, 1, o.nth, digest, chars FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.nth > h
), whole AS (
  SELECT conv_id, coalesce(string_agg(digest, '' ORDER BY part, nth), '') AS path, list(chars ORDER BY part, nth) FILTER (nth IS NOT NULL) AS chars,
    CAST(count(nth) AS BIGINT) AS n
  FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
), members AS (
  SELECT conv_id, depth, left(path, 32 * depth) AS node, n = depth AS ended, coalesce(chars[depth], 0) AS last_chars
  FROM (SELECT *, unnest(range(0, n + 1)) AS depth FROM whole)
), nodes AS (
  SELECT depth, node, min(conv_id) AS least, count(*) AS n_convs, max(last_chars) AS last_chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM members GROUP BY depth, node
), up AS (
  SELECT c.node, left(c.node, 32 * (c.depth - 1)) AS parent FROM nodes c WHERE depth > 0
), families AS (
  SELECT parent AS node, count(*) AS n_children FROM up GROUP BY parent
), above AS (
  SELECT left(node, 32 * unnest(range(0, depth + 1))) AS node, CASE WHEN f.n_children IS NULL THEN 1 ELSE 0 END AS leaf,
    (n_convs - 1) * last_chars AS saved
  FROM nodes LEFT JOIN families f USING (node)
), sums AS (
  SELECT node, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY node
)
SELECT n.least AS conv_id, n.depth, p.least AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
  n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN families USING (node) LEFT JOIN up USING (node) LEFT JOIN nodes p ON p.node = up.parent
"""


@query("op13_prefix_trie", TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All common beginnings of the conversations, each begun like the first of its hundred."""
    own = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS
    return prefix_trie.trie_nodes(prefix_trie.headed(own, F.col("conv_id") - F.col("conv_id") % 100, heads, HEAD_TURNS - 1))
