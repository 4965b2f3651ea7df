"""Operators against pandas on a small panel with ties, holes, a constant symbol, zeros and signs."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators.panel_ops import OPS
from tessera.plans.algebra_queries import ORACLES, node_of
from tessera.plans.expr import PlanError, check, evaluate, lookback, parse


@pytest.fixture(scope="module")
def frame():
    r = np.random.default_rng(5)
    t, n = 60, 5
    x = np.round(r.normal(size=(t, n)), 1)
    y = np.round(r.normal(size=(t, n)), 1)
    x[r.random(x.shape) < 0.1] = np.nan
    y[r.random(y.shape) < 0.1] = np.nan
    x[:, 3] = 2.0
    rows = [(f"S{j}", i, *[None if np.isnan(v) else float(v) for v in (x[i, j], y[i, j], abs(x[i, j]) + 0.5)]) for i in range(t) for j in range(n)]
    return pd.DataFrame(x), pd.DataFrame(y), rows


@pytest.fixture(scope="module")
def panel(spark, frame):
    return spark.createDataFrame(frame[2], "symbol string, t int, x double, y double, z double").cache()


def grid(df, column):
    return df.toPandas().pivot(index="t", columns="symbol", values=column).astype(float).to_numpy()


def test_registry_is_whole_and_every_operator_has_sql():
    assert len(OPS) == 61 and {o.kind for o in OPS.values()} == {"ts", "cs", "el"}
    assert set(ORACLES) == {f"alg_{n}" for n in OPS}


def test_against_pandas(panel, frame):
    x, y, _ = frame
    w = 10
    roll = lambda d, mp: d.rolling(w, min_periods=mp)
    want = {
        "ts_mean[10](x)": roll(x, 5).mean(), "ts_std[10](x)": roll(x, 5).std(), "ts_rank[10](x)": roll(x, 5).rank(pct=True), "ts_skew[10](x)": roll(x, 10).skew(), "ts_kurt[10](x)": roll(x, 10).kurt(),
        "ts_median[10](x)": roll(x, 5).median(), "ts_iqr[10](x)": roll(x, 5).quantile(0.75) - roll(x, 5).quantile(0.25), "ts_delay[3](x)": x.shift(3), "cs_rank(x)": x.rank(axis=1, pct=True),
        "cs_demean(x)": x.sub(x.mean(axis=1), axis=0), "gt(x, y)": (x > y).astype(float), "minv(x, y)": pd.DataFrame(np.minimum(x.to_numpy(), y.to_numpy())),
        "ts_cov[10](x, y)": x.rolling(w, min_periods=5).cov(y),
    }
    got = evaluate(panel, {f"f{i}": e for i, e in enumerate(want)})
    for i, (e, v) in enumerate(want.items()):
        np.testing.assert_allclose(grid(got, f"f{i}"), v.to_numpy(), atol=1e-9, err_msg=e)


def test_later_rows_change_nothing_before(panel):
    names = [n for n, o in OPS.items() if o.kind == "ts"]
    whole = evaluate(panel, {n: node_of(n) for n in names}).where("t < 40").toPandas().sort_values(["symbol", "t"])
    cut = evaluate(panel.where("t < 40"), {n: node_of(n) for n in names}).toPandas().sort_values(["symbol", "t"])
    for n in names:
        np.testing.assert_allclose(whole[n].to_numpy(float), cut[n].to_numpy(float), atol=1e-9, err_msg=n)


def test_lookback_pruning_keeps_results(panel):
    e = {"f": "ts_mean[5](ts_momentum[10](x))", "g": "ts_rank_corr[5](x, y)"}
    a = evaluate(panel, e).where("t >= 45").toPandas().sort_values(["symbol", "t"])
    b = evaluate(panel, e, since=45).toPandas().sort_values(["symbol", "t"])
    for c in e:
        np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), atol=1e-12)


def test_plan_checks():
    cols = {"x", "y"}
    for bad in ("ts_kurt[3](x)", "nope(x)", "ts_mean(x)", "add(x)", "q"):
        with pytest.raises(PlanError):
            check(parse(bad), cols)
    with pytest.raises(PlanError):
        check(parse("cs_rank(x)"), cols, single=True)
    with pytest.raises(PlanError):
        check(parse("cs_rank(cs_rank(x))"), cols, typed=True)
    assert lookback(parse("ts_mean[5](ts_delay[3](x))")) == 7
    assert str(parse("ts_mean[5](add(x, y))")) == "ts_mean[5](add(x, y))"
