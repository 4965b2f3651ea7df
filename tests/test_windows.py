"""Operators whose inputs have holes of their own, at several windows, against pandas."""

import numpy as np
import pandas as pd
import pytest

from tessera.plans.expr import Node, evaluate, leaf


@pytest.fixture(scope="module")
def holed():
    rng = np.random.default_rng(5)
    t, names = 300, ["A", "B", "C"]
    frames = {k: pd.DataFrame(rng.normal(0, 1e-4, (t, 3)).round(7), columns=names) for k in "xyz"}
    for k, f in frames.items():
        frames[k] = f.mask(rng.random(f.shape) < 0.12)
    return frames


def expected(name, p, w):
    """Every moment over its own valid rows, as rolling means of products."""
    m = lambda f, n: f.rolling(w, min_periods=n).mean()
    s = lambda f, n: f.rolling(w, min_periods=n).std()
    x, y, z = p["x"], p["y"], p["z"]
    if name == "ts_slope":
        t = pd.DataFrame(np.tile(np.arange(float(len(x)))[:, None], 3), columns=x.columns)
        n = max(2, w // 2)
        return (m(x * t, n) - m(x, n) * m(t, n)) / x.rolling(w, min_periods=n).var().clip(lower=1e-12)
    if name == "ts_winsor":
        n = max(3, w // 2)
        return x.clip(m(x, n) - 3 * s(x, n), m(x, n) + 3 * s(x, n)).where(m(x, n).notna() & s(x, n).notna())
    if name == "ts_rank_corr":
        n = max(3, w // 2)
        r = [f.rolling(w, min_periods=n).rank(pct=True) for f in (x, y)]
        varies = [f.rolling(w, min_periods=max(3, w)).max() - f.rolling(w, min_periods=max(3, w)).min() > 1e-12 for f in (r[0].where(r[1].notna()), r[1].where(r[0].notna()))]
        return r[0].rolling(w, min_periods=max(3, w)).corr(r[1]).where(varies[0] & varies[1])  # pandas gives noise where a window is constant
    n = max(4, w // 2)
    if name == "ts_coskew":
        top = m(x * x * y, n) - 2 * m(x, n) * m(x * y, n) - m(y, n) * m(x * x, n) + 2 * m(x, n) ** 2 * m(y, n)
        return top / (s(x, n) ** 2 * s(y, n)).clip(lower=1e-18)
    top = m(x * y * z, n) - m(x, n) * m(y * z, n) - m(y, n) * m(x * z, n) - m(z, n) * m(x * y, n) + 2 * m(x, n) * m(y, n) * m(z, n)
    return top / (s(x, n) * s(y, n) * s(z, n)).clip(lower=1e-18)


def windows(name):
    return (5, 10, 250) if name in ("ts_coskew", "ts_triple_corr") else (3, 5, 10, 250)  # those two need four valid rows


def test_own_supports(spark, holed):
    long = pd.concat([f.stack(future_stack=True).rename(k) for k, f in holed.items()], axis=1).reset_index()
    long.columns = ["t", "symbol", "x", "y", "z"]
    df = spark.createDataFrame(long.astype(object).where(long.notna(), None), "t long, symbol string, x double, y double, z double")
    arity = {"ts_slope": "x", "ts_winsor": "x", "ts_rank_corr": "xy", "ts_coskew": "xy", "ts_triple_corr": "xyz"}
    nodes = {f"{n}_{w}": Node(n, tuple(leaf(c) for c in a), w) for n, a in arity.items() for w in windows(n)}
    got = evaluate(df, nodes).toPandas()
    for n in arity:
        for w in windows(n):
            mine = got.pivot(index="t", columns="symbol", values=f"{n}_{w}").astype(float)
            want = expected(n, holed, w)
            assert (mine.isna().to_numpy() == want.isna().to_numpy()).all(), (n, w)
            np.testing.assert_allclose(mine.to_numpy(), want.to_numpy(), rtol=1e-5, atol=1e-5, err_msg=f"{n} {w}")


def test_rolling_pass_equals_frames_without_frames(spark):
    """Means, deviations and extremes over columns of the panel come from one pass by symbol, with holes, short and constant series, and no frame slides in the plan."""
    rng = np.random.default_rng(3)
    rows = []
    for k, n in (("a", 70), ("b", 1), ("c", 3), ("d", 130)):
        for t in range(n):
            rows.append((k, t, None if rng.random() < 0.3 else 7.0 if k == "c" else float(rng.normal() * 100)))
    panel = spark.createDataFrame(rows, "symbol string, t int, c double").repartition(3)
    made = {f"{op}{w}": f"{op}[{w}](c)" for op in ("ts_mean", "ts_std", "ts_sum", "ts_min", "ts_max", "ts_zscore", "ts_range_pos") for w in (3, 5, 10, 60)}
    got = evaluate(panel, made)
    assert "specifiedwindowframe(RowFrame, -" not in got._jdf.queryExecution().optimizedPlan().toString()
    got = got.toPandas().sort_values(["symbol", "t"]).set_index(["symbol", "t"])
    for w in (3, 5, 10, 60):
        least = max(2, w // 2)
        r = got.groupby("symbol")["c"].rolling(w, min_periods=least)
        want = {"ts_mean": r.mean(), "ts_std": r.std(), "ts_sum": r.sum(), "ts_min": r.min(), "ts_max": r.max()}
        want = {k: v.droplevel(0) for k, v in want.items()}
        want["ts_zscore"] = (got["c"] - want["ts_mean"]) / want["ts_std"].clip(lower=1e-12)
        want["ts_range_pos"] = (got["c"] - want["ts_min"]) / (want["ts_max"] - want["ts_min"]).clip(lower=1e-12)
        for op, values in want.items():
            found = got[f"{op}{w}"].astype(float)
            assert (found.isna() == values.isna()).all(), (op, w)
            live = got.index.get_level_values(0) != "c" if op == "ts_zscore" else slice(None)
            np.testing.assert_allclose(found[live].dropna(), values[live].dropna(), rtol=1e-6, atol=1e-6)
