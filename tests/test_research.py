"""Sources, the simulator and the driver contract; the other queries are held against their SQL."""

import datetime as dt
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.operators import evaluation as E
from tessera.operators import inference as I
from tessera.operators.series import account, continuous, simulate
from tessera.sources.panel import Source, densify, from_wide, load, probe, validate

DATA = "/root/testdata/sf0.001"


def test_long_wide_and_symbol_files_agree(spark, tmp_path):
    rows = [(f"2024-01-0{d}", s, d + 1.0, d + 2.0, d * 1.0, d + 1.5, 10.0) for d in (1, 2, 3) for s in ("A", "B_C") if (d, s) != (2, "A")]
    long = spark.createDataFrame(rows, "date string, symbol string, open double, high double, low double, close double, volume double")
    long.write.parquet(f"{tmp_path}/long")
    names = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}
    a = load(spark, Source(f"{tmp_path}/long", mapping=names))
    assert densify(a).count() == 6 and validate(densify(a), 2, 3)["inside"] == 1
    assert set(probe(long)["mapping"]) >= {"date", "symbol", "o", "h", "l", "c", "v"} and not probe(long)["missing"]
    wide = spark.createDataFrame([("2024-01-01", 2.0, 3.0, 1.0, 2.5, 10.0)], "date string, B_C_open double, B_C_high double, B_C_low double, B_C_close double, B_C_volume double")
    w = from_wide(wide, "date").first()
    assert (w.symbol, w.o, w.c, w.v) == ("B_C", 2.0, 2.5, 10.0)
    long.union(long).write.parquet(f"{tmp_path}/twice")
    with pytest.raises(ValueError):
        load(spark, Source(f"{tmp_path}/twice", mapping=names))


def test_simulator_arithmetic(spark):
    panel = spark.createDataFrame([(t, "A", p, p + 1, p - 1, p, True) for t, p in enumerate([10.0, 10.0, 20.0])], "t int, symbol string, o double, h double, l double, c double, listed boolean")
    weights = spark.createDataFrame([("s", 0, "A", 1.0)], "strategy string, t int, symbol string, weight double")
    got = [r.equity for r in simulate(weights, panel, cash=1000.0, commission_bps=0, slippage_bps=0, interest=0).orderBy("t").collect()]
    assert got == pytest.approx([1000.0, 1000.0, 2000.0])


def test_simulator_moves_to_the_last_target_name_by_name(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    n, names = 14, ["A", "B", "C"]
    o = 10 * np.exp(rng.normal(0, 0.05, (n, 3)).cumsum(axis=0))
    c, o[3, 1], lock = o * 1.01, np.nan, {(6, 0), (7, 0), (2, 2)}
    path = [{k: float(v) for k, v in zip(names, rng.dirichlet(np.ones(4))[:3]) if rng.random() < 0.8} for _ in range(n)]
    rows = [(t, k, float(o[t, j]), float(c[t, j]) if (t, j) in lock else float(c[t, j] + 1), float(c[t, j]), float(c[t, j]), (t, j) != (9, 2)) for t in range(n) for j, k in enumerate(names)]
    panel = spark.createDataFrame([tuple(None if x != x else x for x in r) for r in rows], "t int, symbol string, o double, h double, l double, c double, listed boolean")
    weights = spark.createDataFrame([("s", t, k, v) for t, w in enumerate(path) for k, v in w.items()], "strategy string, t int, symbol string, weight double")
    got = simulate(weights, panel).orderBy("t").collect()
    money, held, last, equity, fees, turns = 1e6, dict.fromkeys(names, 0.0), dict(zip(names, c[0])), [], [], []
    for t in range(n):
        deals = []
        if t:
            can = {k: (t, j) not in lock and (t, j) != (9, 2) and o[t, j] == o[t, j] for j, k in enumerate(names)}
            at = {k: o[t, j] if can[k] else last[k] for j, k in enumerate(names)}
            worth = money + sum(held[k] * at[k] for k in names)
            want = {k: path[t - 1].get(k, 0.0) * worth - held[k] * at[k] for k in names if can[k]}
            for k, v in want.items():
                if v < -1e-9 * worth:
                    money, held[k] = money - v * (1 - 2.5e-4), held[k] + v / (at[k] * (1 - 5e-4))
                    deals.append(-v)
            buys = {k: v for k, v in want.items() if v > 1e-9 * worth}
            share = min(1.0, money / (sum(buys.values()) * (1 + 2.5e-4))) if buys else 1.0
            for k, v in buys.items():
                money, held[k] = money - v * share * (1 + 2.5e-4), held[k] + v * share / (at[k] * (1 + 5e-4))
                deals.append(v * share)
        money *= 1 + 0.015 / 252
        last = dict(zip(names, c[t]))
        equity.append(money + sum(held[k] * last[k] for k in names))
        fees.append(sum(deals) * 2.5e-4)
        turns.append(sum(deals) / worth / 2 if t else 0.0)
    assert [r.equity for r in got] == pytest.approx(equity, rel=1e-9)
    assert [r.fees for r in got] == pytest.approx(fees, abs=1e-6) and [r.turnover for r in got] == pytest.approx(turns, abs=1e-9)
    assert got[0].ret is None
    r, e = account(simulate(weights, panel)).first(), np.array(equity)
    x = e[1:] / e[:-1] - 1
    assert r.sharpe == pytest.approx(x.mean() / x.std(ddof=1) * 252**0.5) and r.max_drawdown == pytest.approx((1 - e / np.maximum.accumulate(e)).max()) and r.annual_return == pytest.approx((e[-1] / e[0]) ** (252 / (n - 1)) - 1)
    with pytest.raises(Exception, match="below zero"):
        simulate(spark.createDataFrame([("s", 0, "A", -0.5)], weights.schema), panel).collect()


def test_continuous_contracts(spark):
    day = lambda i: dt.date(2024, 1, i)
    #       contract, day, close, volume, open interest
    rows = [("A", 1, 10.0, 1.0, 5.0), ("B", 1, 20.0, 9.0, 5.0), ("A", 2, 11.0, 1.0, None), ("B", 2, 22.0, 9.0, None), ("A", 3, 12.0, None, None), ("A", 4, 12.0, 1.0, 7.0)]
    schema = "contract string, date date, o double, h double, l double, c double, v double, oi double"
    make = lambda rows: spark.createDataFrame([(k, day(d), c, c, c, c, v, oi) for k, d, c, v, oi in rows], schema)
    got = continuous(make(rows)).orderBy("date").collect()
    assert [r.contract for r in got] == ["A", "B", "B", "A"]  # a tie by name, volume, kept, open interest
    assert [r.roll for r in got] == [False, True, False, True]
    assert [r.factor for r in got] == pytest.approx([1.0, 0.5, 0.5, 0.5 * 22 / 12])
    assert got[0].close2 == 20.0 and got[1].close2 == 5.5 and got[2].close2 is None and got[2].c is None and got[3].c == pytest.approx(11.0)
    with pytest.raises(Exception, match="first contract"):
        continuous(make([("A", 1, 10.0, None, None)])).collect()
    with pytest.raises(Exception, match="closes above zero"):
        continuous(make([("A", 1, 10.0, 1.0, 5.0), ("B", 2, 0.0, 1.0, 5.0)])).collect()


@pytest.mark.parametrize("name", ["continuous", "rank_ic", "ic_stats", "top_k_summary", "market_beta", "alg_ts_rank", "alg_cs_robust_z", "panel_holes"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    a, b = entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(a) == sorted(b) and len(a) == len(b)
    cols = sorted(a)
    keys = [c for c in cols if a[c].dtype != float] or cols
    a, b = (d[cols].sort_values(keys).reset_index(drop=True) for d in (a, b))
    for c in cols:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna()) if a[c].dtype == float else a[c].astype(str).str[:10] == b[c].astype(str).str[:10]
        assert same.all(), c


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 1


def test_the_rest_stands_without_the_corpus_part():
    for p in Path("tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M)
    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 80 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_null_tests_give_z_and_p(spark):
    import math

    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(k, t, dt.date(2020, 1, 1) + dt.timedelta(t), f"s{i}", float(f), float(f * (k == "good") + 3 * e)) for k in ("good", "noise") for t in range(12) for i, (f, e) in enumerate(rng.normal(size=(40, 2)))]
    cells = spark.createDataFrame(rows, "factor string, t int, date date, symbol string, f double, fwd double")
    null = I.permuted_ic(cells, 200, 42)
    got = {r.factor: r for r in I.null_test(I.mean_rank_ic(cells), null).collect()}
    means = {k: [r.mean_ic for r in null.where(f"factor = '{k}'").collect()] for k in got}
    for k, r in got.items():
        z = (r.real_mean - np.mean(means[k])) / np.std(means[k])
        assert r.reps == 200 and abs(r.z - z) < 1e-9 and abs(r.p - math.erfc(abs(z) / math.sqrt(2))) < 1e-12
    assert got["good"].p < 1e-3 < got["noise"].p
    x = rng.normal(0.1, 0.2, 60)
    series = spark.createDataFrame([("x", t, float(v)) for t, v in enumerate(x)] + [("short", t, float(t)) for t in range(9)] + [("flat", t, 0.5) for t in range(20)], "factor string, t int, ic double")
    got = {r.factor: r for r in E.bootstrap_test(series).collect()}
    idx = (rng.integers(0, 60, (2000, 10))[:, :, None] + np.arange(6)) % 60
    se = x[idx.reshape(2000, -1)].mean(axis=1).std(ddof=1)
    r = got["x"]
    assert r.reps == 2000 and abs(r.se / se - 1) < 0.1 and abs(r.z - x.mean() / r.se) < 1e-9 and abs(r.p - math.erfc(abs(r.z) / math.sqrt(2))) < 1e-12
    assert got["short"].z is None and got["flat"].z is None and got["flat"].p is None
