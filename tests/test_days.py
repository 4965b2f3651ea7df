"""Days ranked in one task against the windows and loops they stand for."""

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.functions.hashing import Keys
from tessera.operators import evaluation as E
from tessera.operators import inference as I
from tessera.operators import residuals

ROUND = 9


def made_panel(spark, days=24, names=60, seed=3):
    """Ties, holes, a factor that does not vary, and a day with too few names."""
    r = np.random.default_rng(seed)
    rows = []
    for t in range(days):
        for n in range(names if t != 4 else 20):
            f = float(r.integers(0, 9)) if r.random() < 0.8 else None
            rows.append((f"s{n}", t, pd.Timestamp("2000-01-03").date() + pd.Timedelta(days=t), f, float(r.normal()), 1.0, float(np.round(r.normal(), 1)) if r.random() < 0.9 else None, 1.0 + r.random(), 1.0 + r.random()))
    return spark.createDataFrame(rows, "symbol string, t int, date date, tied double, plain double, flat double, fwd double, o double, c double")


def near(a, b, keys):
    a, b = (d.toPandas().sort_values(keys).reset_index(drop=True).round(ROUND) for d in (a, b))
    assert len(a) and list(a.columns) == list(b.columns)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_day_ic_equals_the_windows_and_needs_none_by_factor(spark):
    p, names = made_panel(spark), ["tied", "plain", "flat"]
    ok = F.col("plain") > -1
    got = E.valued_ic(p, names, 2, ok)
    near(got, E.rank_ic(E.sampled_cells(p, names, 2, ok)), ["factor", "t"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan  # no cell is sorted or copied for each factor
    near(E.day_ic(p.drop("fwd"), names, 3, 2, ok), E.rank_ic(E.cells(p.drop("fwd"), names, 3, 2, ok)), ["factor", "t"])
    assert E.valued_ic(p.limit(0), names, 2, ok).count() == 0


def test_keys_hash_as_hashlib_does():
    names = [b"", b"a", "ü".encode(), b"x" * 40, b"supplier-17"]
    for held in (names, [*names, b"y" * 90]):
        for head in (b"", b"7:", b"42:137:364:"):
            hi, lo = Keys(held).digests(head)
            assert [f"{int(a):016x}{int(b):016x}" for a, b in zip(hi, lo)] == [md5(head + k).hexdigest() for k in held]
            assert Keys(held).order(head).tolist() == sorted(range(len(held)), key=lambda i: md5(head + held[i]).hexdigest())


def test_best_k_and_signature_by_day(spark):
    p, names, ok = made_panel(spark).drop("fwd"), ["tied", "plain", "flat"], F.col("plain") > -1
    block = I.top_k_block(E.cells(p, names, 3, 2, ok))
    days = I.top_k_days(p, names, 3, 2, ok, width=4)
    near(days.select("factor", "t", "k", "spread"), block.select("factor", "t", "k", "spread"), ["factor", "t"])
    picks = block.select("factor", F.explode("held").alias("s"), "t").collect()
    want = {f: [min(md5(f"{i}:{r.t}:{r.s}".encode()).hexdigest() for r in picks if r.factor == f) for i in range(4)] for f in {r.factor for r in picks}}
    assert {r.factor: r.sig for r in I.least_by_place(days, 4).collect()} == want == {r.factor: r.sig for r in I.selection_signature(block, 4).collect()}


def test_nulls_within_a_day(spark):
    """A day is dealt over parts of its own, and its names are hashed once for all factors."""
    cells = E.sampled_cells(made_panel(spark), ["tied", "plain", "flat"], 2, F.lit(True))
    frame = cells.toPandas()
    want: dict = {}
    for (factor, t), g in frame.groupby(["factor", "t"]):
        g = g.sort_values("symbol")
        f, r = g.f.rank().to_numpy(), g.fwd.rank().to_numpy()
        if len(g) < 30 or f.std() == 0:
            continue
        for rep in range(5):
            order = np.argsort([md5(f"42:{rep}:{t}:{s}".encode()).hexdigest() for s in g.symbol])
            k = int(md5(f"9:{rep}:{t}".encode()).hexdigest()[:8], 16) % len(g)
            want.setdefault((factor, rep), []).append((np.corrcoef(f, r[order])[0, 1], np.corrcoef(f, np.roll(r, -k))[0, 1]))
    for made, i in ((I.permuted_ic(cells, 5, 42), 0), (I.rolled_ic(cells, 5, 9), 1)):
        got = {(r.factor, r.rep): r.mean_ic for r in made.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - np.mean([x[i] for x in v])) < 1e-12 for k, v in want.items())
    assert "Generate" not in I.rolled_ic(cells, 5, 9)._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]


def test_residuals_take_no_window_by_day(spark):
    """Ranks of a day's columns were windows, each with a sort of the whole day in the memory of one task."""
    p = made_panel(spark)
    plan = residuals.orthogonal_residual(p, ["plain"], ["tied", "flat"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_beta_and_exposure_by_day(spark):
    """Rolling means come from one pass by symbol, and exposures from the days' own ranks: no window by factor, no sliding frame."""
    p = made_panel(spark).drop("fwd")
    got = I.beta_rolling(p, 6, 4)
    frame = p.toPandas().sort_values(["symbol", "t"])
    frame["r"] = frame.groupby("symbol").c.transform(lambda c: c / c.shift(1) - 1)
    frame["m"] = frame.groupby("t").r.transform("mean")
    roll = lambda x: x.groupby(frame.symbol).transform(lambda v: v.rolling(6, min_periods=4).mean())
    frame["beta"] = (roll(frame.r * frame.m) - roll(frame.r) * roll(frame.m)) / (roll(frame.m * frame.m) - roll(frame.m) ** 2)
    both = got.toPandas().merge(frame[["symbol", "t", "beta"]], on=["symbol", "t"], suffixes=("", "_want"))
    assert both.beta.notna().sum() > 500 and np.allclose(both.beta.astype(float), both.beta_want, rtol=1e-6, equal_nan=True)
    made = I.exposure(got, ["tied", "plain"], "beta", 2)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ROWS BETWEEN" not in plan.upper() and "rank(" not in plan
    assert made.count() == 2
