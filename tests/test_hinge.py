import numpy as np
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gonggo.operators import hinge
from gonggo.operators import models as M


def rows(spark, n=150, size=12):
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        y, at = i % 3, sorted(rng.choice(size - 2, 4, replace=False).tolist())
        values = [1.0 + (k % 3 == y) + rng.random() for k in at]
        # a place that no row has, one that most have, empty rows and dense ones
        x = Vectors.sparse(size, [] if i % 50 == 7 else [*at, size - 1], [] if i % 50 == 7 else [*values, 1 + rng.random() / 9])
        out.append((float(y), 1.0 + y, float(i % 2), Vectors.dense(x.toArray()) if i % 9 == 0 else x))
    return spark.createDataFrame(out, ["label", "weight", "other", "features"]).repartition(3)


def test_fitted_together_as_mllib_fits_alone(spark):
    df = rows(spark).cache()
    versions = [("label", "weight"), ("label", None), ("other", "weight")]
    for steps in (1, 4, 12):
        for (label, weight), got in zip(versions, M.fit_linear_svms(df, versions, steps)):
            base = LinearSVC(maxIter=steps, regParam=1 / 150, standardization=False)
            want = OneVsRest(classifier=base, featuresCol="features", labelCol=label, weightCol=weight).fit(df)
            assert len(got.models) == len(want.models)
            for a, b in zip(got.models, want.models):
                assert np.allclose(a.coefficients.toArray(), b.coefficients.toArray(), atol=1e-6) and abs(a.intercept - b.intercept) < 1e-6
            said = [r[0] for m in (got, want) for r in [m.transform(df).agg(F.sum("prediction")).first()]]
            assert said[0] == said[1]


def test_all_problems_share_their_passes(spark, monkeypatch):
    """Twelve problems ask no oftener than the one that asks most."""
    asked, own = [], hinge._sums
    monkeypatch.setattr(hinge, "minimized", lambda size, steps, run=hinge.minimized: run(size, 3))
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, value: asked.append(len(value)) or broadcast(sc, value))
    M.fit_linear_svms(rows(spark), [("label", "weight"), ("label", None)] * 2, 3)
    assert own is hinge._sums and asked[0] == 12 and len(asked) < 12
