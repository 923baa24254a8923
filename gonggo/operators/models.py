"""Text models of the urgency label, baselines, and the studies run with them."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel,
    OneVsRest, OneVsRestModel)
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import Identifiable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gonggo.functions.joins import small_side
from gonggo.functions.ranks import hash_order
from gonggo.operators import features, hinge, metrics, textprep
from gonggo.operators.urgency import is_measurable, structured_features
from gonggo.session import cut_lineage

FEATURES, LABEL, WEIGHT = "features", "label", "weight"


# ---------------------------------------------------------------- baselines

def majority_constant(train: DataFrame, label: str = "y") -> int:
    """The most frequent label, the smaller of equal ones."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), label).first()[0]


def prior_draw(train: DataFrame, test: DataFrame, label: str = "y", seed: int = 42,
               key: str = "row_id") -> DataFrame:
    """test plus p, drawn by a hash against the cumulated training shares."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()
    total, upto, p = sum(r["n"] for r in counts), 0, None
    place = F.pmod(hash_order(seed, key), F.lit(total))
    for r in counts:
        upto += r["n"]
        p = F.when(place < upto, r[label]) if p is None else p.when(place < upto, r[label])
    return test.withColumn("p", p)


def source_majority(train: DataFrame, test: DataFrame, label: str = "y",
                    source: str = "source") -> DataFrame:
    """test plus p: the source's most frequent label, else the overall one."""
    counts = train.groupBy(source, label).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("n"), (-F.col(label)).alias("_l"))
    own = counts.groupBy(source).agg(F.max(order).alias("_m")) \
        .select(source, (-F.col("_m._l")).alias("_own"))
    overall = (counts.groupBy(label).agg(F.sum("n").alias("n")).agg(F.max(order).alias("_m"))
               .select((-F.col("_m._l")).alias("_g")))
    return test.join(small_side(own), source, "left") \
        .withColumn("p", F.coalesce("_own", overall.scalar())).drop("_own")


# ---------------------------------------------------------------- classifiers

@dataclass
class BoostedModel:
    """One binary model per class; scores are normalised over the classes."""
    members: list
    classes: list

    def transform(self, df: DataFrame) -> DataFrame:
        out, shares = df, []
        for c, m in zip(self.classes, self.members):
            out = (m.transform(out).withColumn(f"_p{c}", vector_to_array("probability")[1])
                   .drop("rawPrediction", "probability", "prediction"))
            shares.append(F.col(f"_p{c}"))
        total = sum(shares, F.lit(0.0))
        by_class = {int(c): F.col(f"_p{c}") / total for c in self.classes}
        p = F.array(*(by_class.get(i, F.lit(0.0)) for i in range(len(metrics.CLASSES))))
        return out.withColumn("probabilities", p).drop(*(f"_p{c}" for c in self.classes))


def fit_linear_svm(train: DataFrame, balanced: bool = True, max_iter: int = 50) -> OneVsRestModel:
    """One-vs-rest linear SVM. C = 1 of the usual form is a penalty of 1 / rows."""
    return fit_linear_svms(train, [(LABEL, WEIGHT if balanced else None)], max_iter)[0]


def fit_linear_svms(train: DataFrame, versions: list[tuple[str, str | None]], max_iter: int = 50) -> list[OneVsRestModel]:
    """One model for each (label column, weight column or None), all fitted in the same passes over the rows."""
    labels = list(dict.fromkeys(c for c, _ in versions))
    rows, *most = train.agg(F.count(F.lit(1)), *(F.max(c) for c in labels)).first()
    classes = {c: int(m) + 1 for c, m in zip(labels, most)}
    penalty = 1.0 / max(rows, 1)
    fitted = iter(hinge.fit_together(train, [hinge.Problem(c, float(i), w) for c, w in versions for i in range(classes[c])],
                                     FEATURES, max_iter, penalty))
    models = []
    for c, w in versions:
        base = LinearSVC(maxIter=max_iter, regParam=penalty, standardization=False)
        ovr = OneVsRest(classifier=base, featuresCol=FEATURES, labelCol=c, weightCol=w)
        models.append(ovr._copyValues(OneVsRestModel(models=[_svm(train.sparkSession, base, *next(fitted)) for _ in range(classes[c])])))
    return models


def _svm(spark: SparkSession, base: LinearSVC, coefficients, intercept: float) -> LinearSVCModel:
    """A model of MLlib's own kind, so that it is saved, loaded and applied as such. It has no summary of its fit, which
    holds the session and can't go to tasks."""
    sc = spark.sparkContext
    made = sc._jvm.org.apache.spark.ml.classification.LinearSVCModel(
        Identifiable._randomUID.__func__(LinearSVCModel), _py2java(sc, DenseVector(coefficients)), intercept)
    return base._copyValues(LinearSVCModel(made))


def fit_logistic(train: DataFrame, balanced: bool = True,
                 max_iter: int = 100) -> LogisticRegressionModel:
    rows = train.count()
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, family="multinomial",
                            maxIter=max_iter, regParam=1.0 / max(rows, 1), standardization=False)
    if balanced:
        lr = lr.setWeightCol(WEIGHT)
    return lr.fit(train)


def fit_boosted(train: DataFrame, validation: DataFrame, trees: int = 400, depth: int = 7,
                step: float = 0.2, tolerance: float = 0.01, seed: int = 42) -> BoostedModel:
    """Boosted trees per class with early stopping on the validation rows."""
    columns = [FEATURES, LABEL]
    both = train.select(*columns, WEIGHT, F.lit(False).alias("_val")).unionByName(
        validation.select(*columns, F.lit(1.0).alias(WEIGHT), F.lit(True).alias("_val")))
    classes = sorted(int(r[0]) for r in train.select(LABEL).distinct().collect())
    members = []
    for c in classes:
        binary = both.withColumn("_y", (F.col(LABEL) == c).cast("double"))
        gbt = GBTClassifier(featuresCol=FEATURES, labelCol="_y", weightCol=WEIGHT, maxIter=trees,
                            maxDepth=depth, stepSize=step, subsamplingRate=0.9,
                            featureSubsetStrategy="0.7", validationIndicatorCol="_val",
                            validationTol=tolerance, seed=seed)
        members.append(gbt.fit(binary))
    return BoostedModel(members, classes)


def predict(model, df: DataFrame, mode: str = "argmax") -> DataFrame:
    """df plus p (level 1..5). mode expected_round needs class probabilities."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("probabilities", vector_to_array("probability"))
    if mode == "expected_round":
        return _plain(out.withColumn("p", metrics.expected_level(F.col("probabilities"))))
    if "prediction" in out.columns:
        return _plain(out.withColumn("p", F.col("prediction").cast("int") + 1))
    return _plain(out.withColumn("p", metrics.top_level(F.col("probabilities"))))


def _plain(df: DataFrame) -> DataFrame:
    return df.drop("rawPrediction", "probability", "prediction")


def gives_probabilities(model) -> bool:
    return not isinstance(model, OneVsRestModel)


# ---------------------------------------------------------------- preparation

@dataclass(frozen=True)
class Recipe:
    """How rows become feature vectors."""
    variant: str = "masked+clean"
    use_text: bool = True
    use_struct: bool = False
    max_features: int = 30_000
    min_df: int = 5
    max_df: float = 0.9
    stop_words: tuple = ()


def _prepared(df: DataFrame, recipe: Recipe) -> DataFrame:
    out = structured_features(df) if recipe.use_struct else df
    return out.withColumn("_text", textprep.apply_variant(F.col("raw_text"), F.col("source"),
                                                          recipe.variant))


def text_vectors(train: DataFrame, others: list[DataFrame], recipe: Recipe):
    """(tfidf model or None, [train, *others] with features); labels play no part.

    The training rows are written once, since fitting scans them twice.
    """
    tables = [_prepared(d, recipe) for d in [train, *others]]
    tfidf, columns = None, []
    if recipe.use_text:
        tables[0] = cut_lineage(tables[0])
        tfidf = features.fit_tfidf(tables[0], "_text", recipe.max_features, recipe.min_df,
                                   recipe.max_df, recipe.stop_words)
        tables = [tfidf.transform(t, "_text") for t in tables]
        columns.append("tfidf")
    if recipe.use_struct:
        columns += features.struct_columns()
    return tfidf, [features.stacked(t, columns, FEATURES).drop("_text", "tfidf", "raw_text") for t in tables]


def with_labels(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(LABEL, (F.col(label) - 1).cast("double"))


def weighted_rows(df: DataFrame, label: str) -> DataFrame:
    """Training rows with label and class weight, written once: every iteration of a fit scans them."""
    return cut_lineage(features.with_class_weight(with_labels(df, label), LABEL, WEIGHT))


def vectors(train: DataFrame, others: list[DataFrame], recipe: Recipe, label: str = "y"):
    """(tfidf model or None, [train, *others] with features, label and weight)."""
    tfidf, done = text_vectors(train, others, recipe)
    return tfidf, [weighted_rows(done[0], label), *(with_labels(d, label) for d in done[1:])]


# ---------------------------------------------------------------- the urgency model

@dataclass
class UrgencyModel:
    """A classifier with everything needed to score a posting the same way."""
    classifier: object
    tfidf: features.TfidfModel | None
    recipe: Recipe
    mode: str
    meta: dict

    def features_of(self, df: DataFrame) -> DataFrame:
        table, columns = _prepared(df, self.recipe), []
        if self.tfidf:
            table, columns = self.tfidf.transform(table, "_text"), ["tfidf"]
        if self.recipe.use_struct:
            columns += features.struct_columns()
        size = (self.tfidf.size if self.tfidf else 0) + (
            len(features.struct_columns()) if self.recipe.use_struct else 0)
        expected = feature_count(self.classifier)
        if expected != size:
            raise ValueError(f"the classifier expects {expected} features, the recipe makes {size}")
        return features.stacked(table, columns, FEATURES).drop("_text", "tfidf")

    def predict(self, df: DataFrame) -> DataFrame:
        return predict(self.classifier, self.features_of(df), self.mode).drop(FEATURES)

    def predict_with_scope(self, df: DataFrame) -> DataFrame:
        """p and in_scope: outside its scope the model was never checked."""
        return self.predict(df).withColumn("in_scope", is_measurable(F.col("raw_text")))

    def save(self, spark: SparkSession, path: str) -> None:
        kind = type(self.classifier).__name__
        if isinstance(self.classifier, BoostedModel):
            for c, m in zip(self.classifier.classes, self.classifier.members):
                m.write().overwrite().save(f"{path}/classifier/{c}")
        else:
            self.classifier.write().overwrite().save(f"{path}/classifier")
        meta = {"kind": kind, "mode": self.mode, "recipe": self.recipe.__dict__, "meta": self.meta,
                "classes": getattr(self.classifier, "classes", None)}
        spark.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string") \
            .write.mode("overwrite").text(f"{path}/meta")
        if self.tfidf:
            self.tfidf.table(spark).write.mode("overwrite").parquet(f"{path}/tfidf")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "UrgencyModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        recipe = Recipe(**{**meta["recipe"], "stop_words": tuple(meta["recipe"]["stop_words"])})
        tfidf = None
        if recipe.use_text:
            rows = spark.read.parquet(f"{path}/tfidf").orderBy("position").collect()
            tfidf = features.TfidfModel(tuple(r["term"] for r in rows),
                                        tuple(r["idf"] for r in rows), recipe.stop_words)
        readers = {"OneVsRestModel": OneVsRestModel, "LogisticRegressionModel": LogisticRegressionModel,
                   "PipelineModel": PipelineModel}
        if meta["kind"] == "BoostedModel":
            classifier = BoostedModel([GBTClassificationModel.load(f"{path}/classifier/{c}")
                                       for c in meta["classes"]], meta["classes"])
        else:
            classifier = readers[meta["kind"]].load(f"{path}/classifier")
        return UrgencyModel(classifier, tfidf, recipe, meta["mode"], meta["meta"])


def feature_count(model) -> int:
    if isinstance(model, BoostedModel):
        return model.members[0].numFeatures
    if isinstance(model, OneVsRestModel):
        return model.models[0].numFeatures
    return model.numFeatures


def one_row(figures: DataFrame, **tags) -> DataFrame:
    return figures.select(*(F.lit(v).alias(k) for k, v in tags.items()), "*")


def stack_rows(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def train_and_select(train: DataFrame, validation: DataFrame, recipe: Recipe = Recipe(),
                     kinds=("linear_svm", "logistic"), label: str = "y", max_iter: int = 50,
                     boosted_options: dict | None = None):
    """(model, validation figures): the best kind and prediction mode by validation qwk."""
    tfidf, (tr, va) = vectors(train, [validation], recipe, label)
    va = cut_lineage(va)
    fitted, rows = {}, []
    for kind in kinds:
        if kind == "linear_svm":
            fitted[kind] = fit_linear_svm(tr, max_iter=max_iter)
        elif kind == "logistic":
            fitted[kind] = fit_logistic(tr, max_iter=max_iter)
        elif kind == "boosted":
            fitted[kind] = fit_boosted(tr, va, **(boosted_options or {}))
        else:
            raise ValueError(f"unknown model {kind!r}")
        modes = ("argmax", "expected_round") if gives_probabilities(fitted[kind]) else ("argmax",)
        for mode in modes:
            rows.append(one_row(metrics.evaluate(predict(fitted[kind], va, mode), label),
                                model=kind, mode=mode))
    figures = cut_lineage(stack_rows(rows))
    # the kind is chosen by argmax, its mode afterwards (equal: expected value)
    kind = metrics.select_best(figures.where("mode = 'argmax'")).first()["model"]
    own = {r["mode"]: r["qwk"] or 0.0 for r in figures.where(F.col("model") == kind).collect()}
    mode = "expected_round" if own.get("expected_round", -2.0) >= own["argmax"] else "argmax"
    return UrgencyModel(fitted[kind], tfidf, recipe, mode, {"model": kind}), figures


# ---------------------------------------------------------------- studies

def transfer(df: DataFrame, labels: dict[str, str], recipe: Recipe = Recipe(),
             min_rows: int = 500, balanced=(True,), max_iter: int = 50,
             source: str = "source") -> DataFrame:
    """Leave-one-source-out: train on the other sources, test on this one.

    One row per label version, held-out source and weighting, with the
    constant baseline (training median) and the gain over it.
    """
    sizes = df.groupBy(source).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    held_out = sorted(r[0] for r in sizes.select(source).collect())
    parts = []
    for name in held_out:
        rest, own = df.where(F.col(source) != name), df.where(F.col(source) == name)
        seen, unseen = (cut_lineage(d) for d in text_vectors(rest, [own], recipe)[1])
        for tag, label in labels.items():
            numbered = seen.withColumn("_label_" + tag, (F.col(label) - 1).cast("double"))
            seen = features.with_class_weight(numbered, "_label_" + tag, "_weight_" + tag)
        versions = [(tag, weighted) for tag in labels for weighted in balanced]
        models = dict(zip(versions, fit_linear_svms(
            seen, [("_label_" + tag, "_weight_" + tag if weighted else None) for tag, weighted in versions], max_iter)))
        for tag, label in labels.items():
            te = with_labels(unseen, label)
            constant = metrics.constant_of(rest, label)
            base = metrics.evaluate(te.withColumn("p", F.lit(constant)), label).select(
                F.col("mae").alias("base_mae"), F.col("off_by_1").alias("base_off_by_1"))
            for weighted in balanced:
                got = metrics.evaluate(predict(models[tag, weighted], te), label)
                base_mae = base.select("base_mae").scalar()
                parts.append(got.select(
                    F.lit(tag).alias("label"), F.lit(name).alias("target"),
                    F.lit("balanced" if weighted else "plain").alias("weighting"),
                    F.lit(constant).alias("base_const"), base_mae.alias("base_mae"),
                    (F.try_divide(base_mae - F.col("mae"), base_mae) * 100).alias("mae_gain_pct"),
                    "n", "qwk", "mae", "off_by_1", "macro_f1", "accuracy"))
    return stack_rows(parts)


def struct_ablation(df: DataFrame, label: str, recipe: Recipe = Recipe(), min_rows: int = 500,
                    max_iter: int = 50) -> DataFrame:
    """Transfer with text, text and structured features, structured features only.

    Structured features restore what masking removed, so they are off elsewhere.
    """
    sets = {"text": (True, False), "text+struct": (True, True), "struct": (False, True)}
    parts = []
    for name, (text, struct) in sets.items():
        own = Recipe(recipe.variant, text, struct, recipe.max_features, recipe.min_df,
                     recipe.max_df, recipe.stop_words)
        parts.append(one_row(transfer(df, {"y": label}, own, min_rows, max_iter=max_iter),
                             feature_set=name))
    return stack_rows(parts)


def leakage(train: DataFrame, test: DataFrame, label: str = "y", recipe: Recipe = Recipe(),
            max_iter: int = 50) -> DataFrame:
    """Macro F1 on full and on masked text, the relative drop and its band."""
    parts = []
    for variant in ("full", "masked"):
        own = Recipe(variant, True, False, recipe.max_features, recipe.min_df, recipe.max_df)
        _, (tr, te) = vectors(train, [test], own, label)
        figures = metrics.evaluate(predict(fit_logistic(tr, max_iter=max_iter), te), label)
        parts.append(figures.select(F.col("macro_f1").alias("f1_" + variant)))
    drop = metrics.relative_drop(F.col("f1_full"), F.col("f1_masked"))
    return (parts[0].select("f1_full", parts[1].scalar().alias("f1_masked"))
            .withColumn("drop_pct", drop).withColumn("band", metrics.drop_band(F.col("drop_pct"))))


def source_classifier(train: DataFrame, test: DataFrame, recipe: Recipe = Recipe(),
                      top: int = 12, max_iter: int = 50, source: str = "source"):
    """How well the source can be told from the text, and by which words.

    Stages: raw text, templates stripped, stripped and without source words.
    Returns (accuracy rows, top word rows).
    """
    names = sorted(r[0] for r in train.select(source).distinct().collect())
    number = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i + 1))))
    tr0, te0 = (d.withColumn("y", number[F.col(source)]) for d in (train, test))
    stripped = tr0.withColumn("_clean", textprep.strip_template(F.col("raw_text"), F.col(source)))
    words = tuple(r[0] for r in textprep.source_stop_words(stripped, "_clean", source)
                  .select("token").collect())
    stages = {"raw": ("full", ()), "strip": ("clean", ()), "strip+sw": ("clean", words)}
    accuracy, top_words = [], []
    for stage, (variant, stop) in stages.items():
        own = Recipe(variant, True, False, recipe.max_features, recipe.min_df, recipe.max_df, stop)
        tfidf, (tr, te) = vectors(tr0, [te0], own, "y")
        model = fit_linear_svm(tr, True, max_iter)
        accuracy.append(one_row(metrics.evaluate(predict(model, te)).select("n", "accuracy"),
                                stage=stage, stop_words=len(stop)))
        for name, member in zip(names, model.models):
            weights = member.coefficients.toArray()
            best = sorted(range(len(weights)), key=lambda i: -weights[i])[:top]
            top_words += [(stage, name, r + 1, tfidf.vocabulary[i], float(weights[i]))
                          for r, i in enumerate(best)]
    rows = train.sparkSession.createDataFrame(
        top_words, "stage string, source string, rank int, term string, weight double")
    return stack_rows(accuracy), rows


def importance(model, tfidf: features.TfidfModel, k: int = 15) -> list[tuple]:
    """The k terms with the largest importance, (rank, term, value)."""
    if isinstance(model, BoostedModel):
        total = sum(m.featureImportances.toArray() for m in model.members) / len(model.members)
    elif isinstance(model, OneVsRestModel):
        total = sum(abs(m.coefficients.toArray()) for m in model.models) / len(model.models)
    else:
        total = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    names = list(tfidf.vocabulary) + features.struct_columns()
    order = sorted(range(len(total)), key=lambda i: (-total[i], i))[:k]
    return [(r + 1, names[i], float(total[i])) for r, i in enumerate(order)]


def fallback_check(train: DataFrame, test: DataFrame, predicted: dict[str, Column],
                   label: str = "y") -> DataFrame:
    """Constant, vocabulary fallback and models on the same test rows.

    predicted: name -> level column of `test`. The constant is the training median.
    """
    columns = {"constant": F.lit(metrics.constant_of(train, label)), **predicted}
    stacked = test.select(F.col(label).alias("y"), F.inline(F.array(*(
        F.struct(F.lit(n).alias("predictor"), c.cast("int").alias("p"))
        for n, c in columns.items()))))
    return metrics.evaluate(stacked, by=("predictor",))
