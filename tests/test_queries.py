"""Every query with SQL gives the same columns and values as DuckDB; the others return sensible rows."""

from dataclasses import replace

import pytest
from oracle import compare, connect

from paths import SMALL
from gearsight.plans import registry, training

registry.load_all()
#: Queries that fit models: here with three trees a fit, all else as registered.
MODELS = {"ablation_leaky", "ablation_strict", "ablation_tuned", "oof_scores", "calibrate", "gbt_metrics", "gbt_score",
          "robustness_model", "feature_importance", "row_drivers", "range_drivers"}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    assert compare(spark, duck, name, registry.QUERIES[name], registry.ORACLES[name], SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name, monkeypatch):
    fit = training.train

    def small(df, features, params=training.Boosting(), *more, **named):
        return fit(df, features, replace(params, trees=3), *more, **named)

    if name in MODELS:
        monkeypatch.setattr(training, "train", small)
    rows = registry.QUERIES[name](spark, SMALL).collect()
    assert rows


def test_model_queries_are_known():
    assert MODELS <= set(registry.QUERIES) - set(registry.ORACLES)
