import inspect

import pytest

from gonggo.operators import models as M
from gonggo.plans import model_queries
from gonggo.plans.catalog import CHECKS

STUDIES = ("saved_model", "transfer_study", "struct_ablation")


def test_registered_fits_are_whole():
    """The registered fits use the operators' own terms, steps, trees and depth."""
    assert model_queries.RECIPE == M.Recipe()
    for name in ("linear_svm_model", "logistic_model", "boosted_model", "model_selection", "leakage_ablation",
                 "source_classifier", "fallback_against_model", *STUDIES):
        source = inspect.getsource(getattr(model_queries, name))
        assert "RECIPE" in source or "_fit_figures" in source
        assert not any(bound in source for bound in ("max_iter", "ITERATIONS", "trees=", "depth=", "max_features"))


@pytest.mark.parametrize("name", STUDIES)
def test_studies_have_sql(name):
    assert name in CHECKS
