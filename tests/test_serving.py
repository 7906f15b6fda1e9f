"""A sealed model gives the same scores on tables, streams, the fleet and entered readings."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from paths import SMALL
from gearsight.functions import constants as C
from gearsight.operators import explain as EX
from gearsight.operators import split as SP
from gearsight.plans import model_queries as MQ
from gearsight.plans import serving as SV
from gearsight.plans import serving_queries as SQ
from gearsight.plans import training as T
from gearsight.sources import telemetry as S
from gearsight.sources.staging import staged


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    rows = staged(SP.chrono_split(MQ._rows(spark, SMALL)))
    model = T.train(rows.filter("split = 'train'"), MQ.CAUSAL, T.Boosting(trees=5, step=0.3, depth=3, min_rows=5))
    path = str(tmp_path_factory.mktemp("artifact"))
    SV.seal(model, path, 0.25)
    return SV.load(spark, path), model, rows


def test_all_paths_agree(spark, served):
    got = {r["path"]: r.asDict() for r in SQ.checks(*served, spark, SMALL).collect()}
    machines = S.telemetry(spark, SMALL).select("machine_id").distinct().count()
    assert {p: r["n_rows"] for p, r in got.items()} == {"batch": 1000, "stream": 1000, "fleet": machines, "whatif": machines}
    assert all(r[c] == 0 for r in got.values() for c in r if c not in ("path", "n_rows"))


def test_margins_equal_a_walk_down_the_trees(served):
    x = np.random.default_rng(1).normal(scale=50, size=(40, len(MQ.CAUSAL)))

    def walk(tree, row, node=0):
        if tree.left[node] < 0:
            return tree.weight * tree.value[node]
        goes_left = row[tree.feature[node]] <= tree.threshold[node]
        return walk(tree, row, (tree.left if goes_left else tree.right)[node])

    trees = served[0].trees
    assert EX.tree_margins(trees, x) == pytest.approx([sum(walk(t, row) for t in trees) for row in x])
    assert EX.tree_margins(trees, x[:0]).shape == (0,)


def test_artifact_keeps_order_and_threshold_and_wants_all_features(served):
    sealed, _, rows = served
    assert sealed.features == MQ.CAUSAL and sealed.threshold == 0.25
    with pytest.raises(AnalysisException):
        sealed.scored(rows.drop("torque")).collect()
    assert sealed.scored(rows.limit(0)).count() == 0


def test_drivers_explain_the_margin(served):
    sealed, _, rows = served
    got = sealed.explained(rows.limit(50), k=len(MQ.CAUSAL)).select(
        "margin", "base", "score", F.aggregate("top_drivers", F.lit(0.0), lambda a, d: a + d["impact"]).alias("sum"),
        *C.RISK_FLAGS, "primary_reason").collect()
    assert len(got) == 50
    for r in got:
        assert r["base"] + r["sum"] == pytest.approx(r["margin"]) and r["score"] == pytest.approx(1 / (1 + np.exp(-2 * r["margin"])))
        assert (r["primary_reason"] in C.REASONS.values()) == any(r[f] for f in C.RISK_FLAGS)


def test_what_ifs_answer_each_request(spark, served):
    rows = S.telemetry(spark, SMALL)
    got = SV.whatif_scored(served[0], SQ.what_ifs(rows), rows).collect()
    assert len(got) == rows.select("machine_id").distinct().count()
    assert all(0 <= r["probability"] <= 1 and len(r["top_drivers"]) == 5 for r in got)
    assert all(r["cold_start_warning"] == 1 for r in got if r["whatif_id"] % 5 == 0)
    assert all(r["borrow_ts_found"] == 0 for r in got if r["whatif_id"] % 5 and r["whatif_id"] % 7 == 0)
