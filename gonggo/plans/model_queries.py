"""Features, baselines, figures and text models over the labelled corpus."""

from __future__ import annotations

import re
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from gonggo.operators import features as V
from gonggo.operators import metrics as E
from gonggo.operators import models as M
from gonggo.operators import textprep as X
from gonggo.operators import urgency as U
from gonggo.plans.corpus import over_corpus, postings, read
from gonggo.plans.match_queries import _hash
from gonggo.plans.registry import query
from gonggo.plans.urgency_queries import V2_SQL, V5_SQL
from gonggo.session import cut_lineage, ensure_checkpoint_dir

RECIPE = M.Recipe()


def labelled(spark, sf_dir, measurable: bool | None = None) -> DataFrame:
    """row_id, source, raw_text, y (rule v5), y_old (rule v2), measurable, add; with `measurable`, only the
    postings that are so, or are not: told by the text alone, so the others are left out before they are scored."""
    rows = postings(spark, sf_dir).select("row_id", "source", "raw_text", "final_techs", "hard_skills")
    if measurable is not None:
        rows = rows.where(U.is_measurable(F.col("raw_text")) == measurable)
    new = U.score_postings(rows, keep_inner=True)
    new = new.select("row_id", "source", "raw_text", "final_techs", "hard_skills", "measurable", "vocabulary",
                     F.col("urgency_score").alias("y"),
                     U.vocabulary_points(F.col("vocabulary")).alias("add"))
    old = U.score_postings(new, pack=U.V2, known=True)
    return old.select("row_id", "source", "raw_text", "final_techs", "hard_skills", "measurable", "y",
                      F.col("urgency_score").alias("y_old"), "add")


def _labelled_sql() -> str:
    """Table `labelled` like the function above, from both rule versions."""
    old = []
    for step in V2_SQL:
        for name in ("bodies", "segments", "dated", "ranged", "windows", "signals", "evidence",
                     "levels", "scored"):
            step = re.sub(rf"\b{name} AS \(SELECT", f"{name}_v2 AS (SELECT", step)
            step = re.sub(rf"\bFROM {name}\)", f"FROM {name}_v2)", step)
        old.append(step)
    return ",\n".join([*V5_SQL, *old, """labelled AS (
        SELECT a.row_id, a.source, a.raw_text, a.final_techs, a.hard_skills, a.measurable,
               a.urgency_score AS y, b.urgency_score AS y_old, a.vocabulary_points AS add
        FROM scored a JOIN scored_v2 b USING (row_id))"""])


LABELLED_SQL = _labelled_sql()


# ---------------------------------------------------------------- features

@query("aux_features", over_corpus("""
    SELECT row_id, len(final_techs) AS n_final_techs, len(hard_skills) AS n_hard_skills, 0 AS n_soft_skills,
      len(final_techs) + len(hard_skills) AS n_skills_total, length(raw_text) AS len_raw_text,
      length(raw_text) - length(replace(raw_text, chr(10), '')) + 1 AS n_lines,
      length(regexp_replace(raw_text, '[^0-9]', '', 'g')) AS n_digits FROM postings"""))
def aux_features(spark, sf_dir):
    rows = postings(spark, sf_dir).select("row_id", "raw_text", "final_techs", "hard_skills")
    return V.aux_features(rows).select("row_id", "n_final_techs", "n_hard_skills", "n_soft_skills",
                                       "n_skills_total", "len_raw_text", "n_lines", "n_digits")


@query("aux_scaled", over_corpus("""
    SELECT row_id, round((v - avg(v) OVER ()) / stddev_samp(v) OVER (), 6) AS text_length,
      round((t - avg(t) OVER ()) / stddev_samp(t) OVER (), 6) AS techs
    FROM (SELECT row_id, length(raw_text) AS v, len(final_techs) AS t FROM postings)"""))
def aux_scaled(spark, sf_dir):
    """Sizes centred and scaled by the training rows (here: all)."""
    rows = V.aux_features(postings(spark, sf_dir).select("row_id", "raw_text", "final_techs", "hard_skills"))
    names = ("len_raw_text", "n_final_techs")
    scaled = V.scaled(cut_lineage(rows.select("row_id", *names)), [], names)[0]
    v = vector_to_array("aux")
    return scaled.select("row_id", F.round(v[0], 6).alias("text_length"), F.round(v[1], 6).alias("techs"))


_TERMS = f"""tokens AS (SELECT doc_id, regexp_extract_all(lower(text), '{X.TOKEN}') AS w FROM documents),
  terms AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tokens),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
  stats AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
  vocabulary AS (SELECT term, df, cf, ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1 AS idf FROM stats
    WHERE df >= 5 AND df <= (SELECT count(*) FROM documents) * 0.9 ORDER BY cf DESC, term LIMIT 30000)"""


@query("tfidf_vocabulary", f"WITH {_TERMS} SELECT term, df, cf, round(idf, 9) AS idf FROM vocabulary",
       BIGINT=("cf",))
def tfidf_vocabulary(spark, sf_dir):
    return V.vocabulary_table(read(spark, sf_dir, "documents"), "text").select(
        "term", "df", "cf", F.round("idf", 9).alias("idf"))


@query("tfidf_vectors", f"""WITH {_TERMS}, weighted AS (SELECT doc_id, (1 + ln(tf)) * idf AS w FROM tf JOIN vocabulary USING (term))
    SELECT d.doc_id, count(w) AS entries, coalesce(round(sum(w) / sqrt(sum(w * w)), 6), 0) AS total,
      coalesce(round(max(w) / sqrt(sum(w * w)), 6), 0) AS largest
    FROM documents d LEFT JOIN weighted USING (doc_id) GROUP BY d.doc_id""")
def tfidf_vectors(spark, sf_dir):
    """Entries, sum and maximum of each document's unit vector."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = V.fit_tfidf(docs, "text").transform(docs, "text").select(
        "doc_id", F.unwrap_udt("tfidf")["values"].alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return done.select("doc_id", F.size("v").alias("entries"), F.round(total, 6).alias("total"),
                       F.coalesce(F.round(F.array_max("v"), 6), F.lit(0.0)).alias("largest"))


@query("class_weights", over_corpus("""SELECT y, count(*) AS n, round((SELECT count(*) FROM labelled)
    / ((SELECT count(DISTINCT y) FROM labelled) * count(*)), 9) AS weight FROM labelled GROUP BY y""", LABELLED_SQL))
def class_weights(spark, sf_dir):
    return V.class_weights(labelled(spark, sf_dir)).select("y", "n", F.round("weight", 9).alias("weight"))


# ---------------------------------------------------------------- baselines and figures

def figures_sql(table: str, by: str = "", y: str = "y", p: str = "p") -> str:
    f1 = " + ".join(f"coalesce(2.0 * sum(CASE WHEN {y} = {c} AND {p} = {c} THEN 1 ELSE 0 END) / nullif("
                    f"sum(CASE WHEN {y} = {c} THEN 1 ELSE 0 END) + sum(CASE WHEN {p} = {c} THEN 1 ELSE 0 END), 0), 0)"
                    for c in E.CLASSES)
    present = " + ".join(f"max(CASE WHEN {y} = {c} OR {p} = {c} THEN 1 ELSE 0 END)" for c in E.CLASSES)
    group = f"GROUP BY {by}" if by else ""
    # kappa from the two margins: expected disagreement of independent draws
    return f"""SELECT {by + ', ' if by else ''}count(*) AS n, round(1 - sum(({y} - {p}) * ({y} - {p}))
        / nullif(sum({y} * {y}) + sum({p} * {p}) - 2.0 * sum({y}) * sum({p}) / count(*), 0), 6) AS qwk,
      round(avg(abs({y} - {p})), 6) AS mae, round(avg(CASE WHEN abs({y} - {p}) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS off_by_1,
      round(({f1}) / ({present}), 6) AS macro_f1, round(avg(CASE WHEN {y} = {p} THEN 1.0 ELSE 0.0 END), 6) AS accuracy
      FROM {table} {group}"""


@query("label_metrics", over_corpus(figures_sql("labelled", p="y_old"), LABELLED_SQL))
def label_metrics(spark, sf_dir):
    """Agreement of the two rule versions."""
    return E.rounded(E.evaluate(labelled(spark, sf_dir), "y", "y_old"))


@query("source_metrics", over_corpus(figures_sql("labelled", "source", p="y_old"), LABELLED_SQL))
def source_metrics(spark, sf_dir):
    return E.rounded(E.evaluate(labelled(spark, sf_dir), "y", "y_old", ("source",)))


@query("kappa_by_matrix", """
    WITH d AS (SELECT c_custkey % 5 + 1 AS y, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p, o_orderstatus
               FROM orders JOIN customer ON o_custkey = c_custkey),
      o AS (SELECT o_orderstatus, y, p, count(*) AS n FROM d GROUP BY ALL),
      r AS (SELECT o_orderstatus, y, sum(n) AS n FROM o GROUP BY ALL), c AS (SELECT o_orderstatus, p, sum(n) AS n FROM o GROUP BY ALL),
      t AS (SELECT o_orderstatus, sum(n) AS n FROM o GROUP BY ALL),
      e AS (SELECT o_orderstatus, sum((r.y - c.p) * (r.y - c.p) * r.n * c.n / t.n) AS v FROM r JOIN c USING (o_orderstatus) JOIN t USING (o_orderstatus) GROUP BY ALL)
    SELECT o_orderstatus, round(1 - (SELECT sum((y - p) * (y - p) * n) FROM o WHERE o.o_orderstatus = e.o_orderstatus) / v, 6) AS qwk FROM e""")
def kappa_by_matrix(spark, sf_dir):
    """Quadratic kappa, checked against the full matrix of expected counts."""
    rows = read(spark, sf_dir, "orders").select(
        "o_orderstatus", (F.col("o_custkey") % 5 + 1).cast("int").alias("y"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("p"))
    return E.evaluate(rows, by=("o_orderstatus",)).select("o_orderstatus", F.round("qwk", 6).alias("qwk"))


@query("confusion_matrix", over_corpus("SELECT y AS truth, " + ", ".join(
    f"sum(CASE WHEN y_old = {c} THEN 1 ELSE 0 END) AS pred_{c}" for c in E.CLASSES) + " FROM labelled GROUP BY y", LABELLED_SQL),
       BIGINT=tuple(f"pred_{c}" for c in E.CLASSES))
def confusion_matrix(spark, sf_dir):
    return E.confusion(labelled(spark, sf_dir), "y", "y_old")


@query("class_report", over_corpus(" UNION ALL ".join(
    f"""SELECT {c} AS label, coalesce(round(sum(CASE WHEN y = {c} AND y_old = {c} THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN y_old = {c} THEN 1 ELSE 0 END), 0), 6), 0) AS precision,
      coalesce(round(sum(CASE WHEN y = {c} AND y_old = {c} THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN y = {c} THEN 1 ELSE 0 END), 0), 6), 0) AS recall,
      coalesce(round(2.0 * sum(CASE WHEN y = {c} AND y_old = {c} THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN y = {c} THEN 1 ELSE 0 END) + sum(CASE WHEN y_old = {c} THEN 1 ELSE 0 END), 0), 6), 0) AS f1,
      sum(CASE WHEN y = {c} THEN 1 ELSE 0 END) AS support FROM labelled""" for c in E.CLASSES), LABELLED_SQL),
       BIGINT=("support",))
def class_report(spark, sf_dir):
    return E.rounded(E.class_report(labelled(spark, sf_dir), "y", "y_old"))


_MODE = "(SELECT {0} FROM labelled {1} GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1)"


@query("majority_baseline", over_corpus(
    figures_sql(f"(SELECT y, {_MODE.format('y', '')} AS p FROM labelled)"), LABELLED_SQL))
def majority_baseline(spark, sf_dir):
    rows = cut_lineage(labelled(spark, sf_dir).select("y"))
    return E.rounded(E.evaluate(rows.withColumn("p", F.lit(M.majority_constant(rows)))))


@query("prior_baseline", over_corpus(figures_sql(f"""(SELECT y, (SELECT min(c.y) FROM cumulated c WHERE place < c.upto) AS p FROM (
      SELECT y, {_hash("'42'", 'row_id')} % (SELECT count(*) FROM labelled) AS place FROM labelled))"""), LABELLED_SQL,
    "cumulated AS (SELECT y, sum(count(*)) OVER (ORDER BY y) AS upto FROM labelled GROUP BY y)"))
def prior_baseline(spark, sf_dir):
    """Labels drawn from the training shares by a hash."""
    rows = cut_lineage(labelled(spark, sf_dir).select("row_id", "y"))
    return E.rounded(E.evaluate(M.prior_draw(rows, rows)))


@query("source_majority", over_corpus(figures_sql(
    f"""(SELECT l.y, coalesce(m.p, {_MODE.format('y', "WHERE source <> 'wanted'")}) AS p FROM labelled l LEFT JOIN modes m USING (source))"""),
    LABELLED_SQL, """modes AS (SELECT source, y AS p FROM (SELECT source, y, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, y) AS r
      FROM labelled WHERE source <> 'wanted' GROUP BY 1, 2) WHERE r = 1)"""))
def source_majority(spark, sf_dir):
    """The source's usual label; wanted is unseen in training and gets the overall one."""
    rows = cut_lineage(labelled(spark, sf_dir).select("source", "y"))
    train = rows.where("source <> 'wanted'")
    return E.rounded(E.evaluate(M.source_majority(train, rows)))


_SHARES = "[" + ", ".join(f"avg(CASE WHEN o_orderpriority LIKE '{i}-%' THEN 1.0 ELSE 0.0 END)" for i in range(1, 6)) + "]"


@query("expected_levels", f"""SELECT o_custkey, greatest(0, least(4, CAST(round_even(((((0.0 + p[1] * 0) + p[2] * 1) + p[3] * 2) + p[4] * 3) + p[5] * 4, 0) AS INTEGER))) + 1 AS expected,
    list_position(p, list_max(p)) AS top FROM (SELECT o_custkey, {_SHARES} AS p FROM orders GROUP BY o_custkey)""")
def expected_levels(spark, sf_dir):
    """Expected-value rounding beside argmax, on each customer's priority shares."""
    shares = [F.avg(F.startswith("o_orderpriority", F.lit(f"{i}-")).cast("double")) for i in range(1, 6)]
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array(*shares).alias("p"))
    return rows.select("o_custkey", E.expected_level(F.col("p")).alias("expected"),
                       E.top_level(F.col("p")).alias("top"))


# ---------------------------------------------------------------- the vocabulary fallback

_GRID = """grid AS (SELECT base, CAST(scale AS DOUBLE) AS scale FROM (VALUES (1), (2), (3)) b(base), (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) s(scale)),
  cells AS (SELECT base, scale, y, greatest(1, least(5, CAST(floor(base + add * scale + 0.5) AS INTEGER))) AS p
    FROM labelled, grid WHERE measurable),
  scored_cells AS (SELECT base, scale, count(*) AS n, 1 - sum((y - p) * (y - p)) / nullif(sum(y * y) + sum(p * p) - 2.0 * sum(y) * sum(p) / count(*), 0) AS qwk,
    avg(abs(y - p)) AS mae FROM cells GROUP BY base, scale)"""


@query("fallback_grid", over_corpus(
    "SELECT base, scale, n, round(qwk, 6) AS qwk, round(mae, 6) AS mae FROM scored_cells", LABELLED_SQL, _GRID))
def fallback_grid(spark, sf_dir):
    return E.rounded(E.fallback_grid(labelled(spark, sf_dir).where("measurable")))


@query("fallback_choice", over_corpus("""SELECT base, scale, round(qwk, 6) AS qwk, round(mae, 6) AS mae FROM scored_cells
    WHERE qwk >= (SELECT qwk FROM scored_cells WHERE base = 3 AND scale = 1.0) ORDER BY mae, qwk DESC, base, scale LIMIT 1""",
    LABELLED_SQL, _GRID))
def fallback_choice(spark, sf_dir):
    grid = E.fallback_grid(labelled(spark, sf_dir).where("measurable"))
    return E.rounded(E.choose_fallback(cut_lineage(grid))).select("base", "scale", "qwk", "mae")


@query("unmeasurable_shift", over_corpus("""SELECT base, scale, count(*) AS n, sum(CASE WHEN add = 0 THEN 1 ELSE 0 END) AS zero_evidence, """
    + ", ".join(f"sum(CASE WHEN p = {c} THEN 1 ELSE 0 END) AS level_{c}" for c in E.CLASSES)
    + """, round(sum(CASE WHEN add = 0 THEN 1 ELSE 0 END) * 100 / count(*), 1) AS zero_pct, round(greatest("""
    + ", ".join(f"sum(CASE WHEN p = {c} THEN 1 ELSE 0 END)" for c in E.CLASSES)
    + """) * 100 / count(*), 1) AS modal_pct FROM (SELECT base, CAST(scale AS DOUBLE) AS scale, add,
      greatest(1, least(5, CAST(floor(base + add * scale + 0.5) AS INTEGER))) AS p FROM labelled, (VALUES (3, 1.0), (2, 0.25), (1, 0.5)) v(base, scale)
      WHERE NOT measurable) GROUP BY base, scale""", LABELLED_SQL),
       BIGINT=("zero_evidence", *(f"level_{c}" for c in E.CLASSES)))
def unmeasurable_shift(spark, sf_dir):
    return E.unmeasurable_shift(labelled(spark, sf_dir, measurable=False),
                                [(3, 1.0), (2, 0.25), (1, 0.5)])


_FALLBACK = "greatest(1, least(5, CAST(floor(2 + add * 0.25 + 0.5) AS INTEGER)))"


@query("fallback_check", over_corpus(figures_sql(f"""(
    SELECT 'constant' AS predictor, y, CAST((SELECT trunc(quantile_cont(y, 0.5)) FROM labelled WHERE source = 'saramin') AS INTEGER) AS p FROM labelled WHERE source <> 'saramin'
    UNION ALL SELECT 'vocabulary', y, {_FALLBACK} FROM labelled WHERE source <> 'saramin'
    UNION ALL SELECT 'old_rule', y, y_old FROM labelled WHERE source <> 'saramin')""", "predictor"), LABELLED_SQL))
def fallback_check(spark, sf_dir):
    """Constant (median of one source, on the others), vocabulary fallback and another predictor."""
    rows = labelled(spark, sf_dir).select("source", "y", "y_old", "add")
    out = M.fallback_check(rows.where("source = 'saramin'"), rows.where("source <> 'saramin'"), {
        "vocabulary": U.fallback_level(F.col("add"), 2, 0.25), "old_rule": F.col("y_old")})
    return E.rounded(out)


@query("unmeasurable_labels", over_corpus("""SELECT which, level, count(*) AS n,
    round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY which), 1) AS share_pct FROM (
      SELECT 'y' AS which, y AS level FROM labelled WHERE NOT measurable
      UNION ALL SELECT 'y_old', y_old FROM labelled WHERE NOT measurable) GROUP BY 1, 2""", LABELLED_SQL))
def unmeasurable_labels(spark, sf_dir):
    """Level shares of unmeasurable postings before and after a label change."""
    return E.level_shares(labelled(spark, sf_dir).where("not measurable"), "y", "y_old")


@query("label_gain", over_corpus(
    """SELECT label, source, round(mae, 6) AS mae, round(base_mae, 6) AS base_mae,
       round((base_mae - mae) * 100 / nullif(base_mae, 0), 6) AS mae_gain_pct FROM errors""", LABELLED_SQL,
    """consts AS (SELECT source, CAST(trunc(quantile_cont(y, 0.5)) AS INTEGER) AS c, CAST(trunc(quantile_cont(y_old, 0.5)) AS INTEGER) AS c_old FROM labelled GROUP BY source)""",
    """errors AS (SELECT 'v5' AS label, source, avg(abs(y - add)) AS mae, avg(abs(y - c)) AS base_mae FROM labelled JOIN consts USING (source) GROUP BY source
      UNION ALL SELECT 'v2', source, avg(abs(y_old - add)), avg(abs(y_old - c_old)) FROM labelled JOIN consts USING (source) GROUP BY source)"""))
def label_gain(spark, sf_dir):
    """Error of one predictor under two label versions, over each label's own constant."""
    rows = cut_lineage(labelled(spark, sf_dir).select("source", "y", "y_old", "add"))
    got, base = [], []
    for tag, label in (("v5", "y"), ("v2", "y_old")):
        middle = rows.groupBy("source").agg(F.percentile(label, 0.5).cast("int").alias("c"))
        got.append(M.one_row(E.evaluate(rows, label, "add", ("source",)), label=tag))
        base.append(M.one_row(E.evaluate(rows.join(middle, "source"), label, "c", ("source",)), label=tag))
    out = E.gain_over_constant(M.stack_rows(got), M.stack_rows(base), ["label", "source"])
    return E.rounded(out.select("label", "source", "mae", "base_mae", "mae_gain_pct"))


@query("label_history", over_corpus("""SELECT 'v2' AS label, source, count(*) AS n, round(avg(y_old), 6) AS mean_level FROM labelled GROUP BY source
    UNION ALL SELECT 'v5', source, count(*), round(avg(y), 6) FROM labelled GROUP BY source""", LABELLED_SQL))
def label_history(spark, sf_dir):
    """Results measured again replace the kept rows of the same label."""
    rows = cut_lineage(labelled(spark, sf_dir).select("source", "y", "y_old"))

    def measured(tag, label):
        return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(label), 6)
                                          .alias("mean_level")).select(F.lit(tag).alias("label"), "*")
    kept = measured("v2", "y_old").unionByName(measured("v5", "y_old"))
    return E.merge_history(kept, measured("v5", "y"))


# ---------------------------------------------------------------- text models

def parts(spark, sf_dir):
    """(train, validation, test) of the measurable postings, copies kept together."""
    rows = labelled(spark, sf_dir, measurable=True).select(
        "row_id", "source", "raw_text", "final_techs", "hard_skills", "y", "y_old", "add")
    kept = X.absorb_rare(X.drop_exact_copies(cut_lineage(rows)), "y")
    split = cut_lineage(X.group_split(kept))
    return tuple(split.where(F.col("split") == s) for s in ("train", "val", "test"))


def _fit_figures(spark, sf_dir, fit, mode="argmax", recipe=RECIPE):
    train, _, test = parts(spark, sf_dir)
    _, (tr, te) = M.vectors(train, [test], recipe)
    return E.rounded(E.evaluate(M.predict(fit(tr), te, mode)), 4)


@query("linear_svm_model")
def linear_svm_model(spark, sf_dir):
    return _fit_figures(spark, sf_dir, lambda tr: M.fit_linear_svm(tr))


@query("logistic_model")
def logistic_model(spark, sf_dir):
    return _fit_figures(spark, sf_dir, lambda tr: M.fit_logistic(tr), "expected_round")


@query("boosted_model")
def boosted_model(spark, sf_dir):
    """Boosted trees per class with early stopping, and their strongest terms."""
    train, val, test = parts(spark, sf_dir)
    tfidf, (tr, va, te) = M.vectors(train, [val, test], RECIPE)
    model = M.fit_boosted(tr, va)
    figures = E.rounded(E.evaluate(M.predict(model, te, "expected_round")), 4)
    top = spark.createDataFrame(M.importance(model, tfidf, 5), "rank int, term string, value double")
    return top.select("rank", "term", F.round("value", 4).alias("value"),
                      figures.select("qwk").scalar().alias("qwk"),
                      figures.select("mae").scalar().alias("mae"))


@query("model_selection")
def model_selection(spark, sf_dir):
    """Validation figures of each kind and mode, and the test figures of the chosen one."""
    train, val, test = parts(spark, sf_dir)
    model, figures = M.train_and_select(train, val, RECIPE)
    final = M.one_row(E.evaluate(model.predict(test)), model=model.meta["model"], mode=model.mode)
    return E.rounded(M.one_row(figures, part="validation").unionByName(M.one_row(final, part="test")), 4)


@query("saved_model", over_corpus("""SELECT source, measurable AS in_scope, count(*) AS n, true AS same_after_load
    FROM labelled GROUP BY 1, 2""", LABELLED_SQL))
def saved_model(spark, sf_dir):
    """A saved and reloaded model predicts every posting as it did before, in and out of its scope."""
    train, val, _ = parts(spark, sf_dir)
    model, _ = M.train_and_select(train, val, RECIPE, ("logistic",))
    path = f"{ensure_checkpoint_dir(spark)}/urgency-model-{uuid.uuid4().hex}"
    model.save(spark, path)
    before = model.predict(labelled(spark, sf_dir).select("row_id", "source", "raw_text")).select(
        "row_id", "source", "raw_text", F.col("p").alias("before"))
    scored = M.UrgencyModel.load(spark, path).predict_with_scope(before)
    return scored.groupBy("source", "in_scope").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("p") == F.col("before")).alias("same_after_load"))


def _held_out_sql(tag: str, y: str, weightings: tuple[str, ...]) -> str:
    """Rows of each held-out source and the constant of the others, for one label version."""
    return f"""SELECT '{tag}' AS label, t.source AS target, w.weighting, count(*) AS n, any_value(c.c) AS base_const,
      round(avg(abs(t.{y} - c.c)), 4) AS base_mae, true AS complete
    FROM measured t JOIN (SELECT s.source, CAST(trunc((SELECT quantile_cont(x.{y}, 0.5) FROM measured x
        WHERE x.source <> s.source)) AS INTEGER) AS c FROM measured s GROUP BY s.source HAVING count(*) >= 50) c USING (source),
      (VALUES {", ".join(f"('{w}')" for w in weightings)}) w(weighting) GROUP BY t.source, w.weighting"""


_MEASURED = "measured AS (SELECT * FROM labelled WHERE measurable)"


def _checked(figures: DataFrame, *keys: str) -> DataFrame:
    """What a study rests on, and whether the model gave all figures, within their ranges."""
    shares = [F.col(c).between(0, 1) for c in ("off_by_1", "macro_f1", "accuracy")]
    complete = F.coalesce(F.col("mae").between(0, 4) & shares[0] & shares[1] & shares[2], F.lit(False))
    return figures.select(*keys, "label", "target", "weighting", "n", "base_const",
                          F.round("base_mae", 4).alias("base_mae"), complete.alias("complete"))


@query("transfer_study", over_corpus(" UNION ALL ".join(
    _held_out_sql(tag, y, ("balanced", "plain")) for tag, y in (("v2", "y_old"), ("v5", "y"))), LABELLED_SQL, _MEASURED))
def transfer_study(spark, sf_dir):
    """Leave one source out, under old and new labels, with and without class weights."""
    rows = cut_lineage(labelled(spark, sf_dir, measurable=True))
    return _checked(M.transfer(rows, {"v2": "y_old", "v5": "y"}, RECIPE, 50, (True, False)))


@query("struct_ablation", over_corpus(
    f"SELECT * FROM (VALUES ('text'), ('text+struct'), ('struct')) f(feature_set), ({_held_out_sql('y', 'y', ('balanced',))})",
    LABELLED_SQL, _MEASURED))
def struct_ablation(spark, sf_dir):
    """The same on text, text and structured features, and structured features only."""
    rows = cut_lineage(labelled(spark, sf_dir, measurable=True))
    return _checked(M.struct_ablation(rows, "y", RECIPE, 50), "feature_set")


@query("transfer_figures")
def transfer_figures(spark, sf_dir):
    """The transfer study's own figures: kappa, error and gain of the model in each held-out source."""
    rows = cut_lineage(labelled(spark, sf_dir, measurable=True))
    return E.rounded(M.transfer(rows, {"v2": "y_old", "v5": "y"}, RECIPE, 50, (True, False)), 4)


@query("struct_figures")
def struct_figures(spark, sf_dir):
    """The figures of the study on text and structured features."""
    rows = cut_lineage(labelled(spark, sf_dir, measurable=True))
    return E.rounded(M.struct_ablation(rows, "y", RECIPE, 50), 4)


@query("leakage_ablation")
def leakage_ablation(spark, sf_dir):
    """How much of the score comes from the phrases the labels were made of."""
    rows = X.stratified_split(cut_lineage(X.absorb_rare(labelled(spark, sf_dir).select(
        "row_id", "source", "raw_text", "y"), "y", least=2)), "stratum")
    split = cut_lineage(rows)
    return E.rounded(M.leakage(split.where("split = 'train'"), split.where("split = 'test'"),
                               recipe=RECIPE), 4)


@query("source_classifier")
def source_classifier(spark, sf_dir):
    """Accuracy of telling the source from the text after each cleaning stage, and the words that tell it."""
    rows = cut_lineage(X.stratified_split(postings(spark, sf_dir).select("row_id", "source", "raw_text"), "source"))
    accuracy, words = M.source_classifier(rows.where("split = 'train'"), rows.where("split = 'test'"),
                                          RECIPE, 5)
    named = F.transform(F.array_sort(F.collect_list(F.struct("source", "rank", "term"))),
                        lambda w: F.concat(w["source"], F.lit(":"), w["term"]))
    best = words.groupBy("stage").agg(F.count(F.lit(1)).alias("listed_words"), F.array_join(named, "|").alias("top_words"))
    return E.rounded(accuracy.join(best, "stage"), 4)


@query("fallback_against_model")
def fallback_against_model(spark, sf_dir):
    """Constant, vocabulary fallback and the text model on the same test rows."""
    train, _, test = parts(spark, sf_dir)
    _, (tr, te) = M.vectors(train, [test], RECIPE)
    scored = M.predict(M.fit_logistic(tr), te, "expected_round")
    return E.rounded(M.fallback_check(train, scored, {
        "vocabulary": U.fallback_level(F.col("add"), 2, 0.25), "model": F.col("p")}), 4)
