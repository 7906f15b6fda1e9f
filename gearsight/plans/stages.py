"""The four feature stages and the column lists a model may see in each."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gearsight.functions import constants as C
from gearsight.operators import clean as K
from gearsight.operators import features as FE
from gearsight.operators import fusion as FU
from gearsight.operators import windows as W

STAGES = ["alpha", "beta", "gamma", "delta"]
KEYS = ["event_id", "machine_id", "ts"]


def alpha(readings: DataFrame) -> DataFrame:
    """Cleaned readings."""
    out = K.drop_ids(K.encode_type(readings))
    return out.select(*KEYS, "type", "type_code", *C.SENSORS, C.TARGET, *C.MODES)


def beta(cleaned: DataFrame) -> DataFrame:
    """Static features."""
    return FE.static_features(cleaned)


def gamma(static: DataFrame) -> DataFrame:
    """Sequence id, cycle, rolling and lag features; the series layout is found once for all of them."""
    layout = W.series(static)
    out = W.tool_cycle(W.assign_timeline(static), layout=layout)
    out = W.rolling_features(out, C.CORE_SIGNALS, layout=layout)
    out = W.rolling_features(out, C.CORE_SIGNALS, scope="tool", layout=layout)
    return W.lag_features(out, layout=layout)


def delta(temporal: DataFrame) -> DataFrame:
    """Context, cross-domain and rolling context features."""
    return W.rolling_context(FE.fusion_features(FU.synthetic_context(temporal)))


def build(readings: DataFrame, stage: str) -> DataFrame:
    out = alpha(readings)
    for name, step in (("beta", beta), ("gamma", gamma), ("delta", delta)):
        if STAGES.index(stage) >= STAGES.index(name):
            out = step(out)
    return out


def model_columns(df: DataFrame, leaky: bool = False) -> list[str]:
    """Model inputs of a stage. ``leaky`` keeps the failure modes and the grade, as a warning example."""
    banned = {C.TARGET, *KEYS} | (set() if leaky else {*C.MODES, "type", "type_code"})
    return sorted(c for c in K.numeric_columns(df) if c not in banned)
