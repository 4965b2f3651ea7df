"""Residuals, selection luck, the tail wall and families against NumPy, sequential loops and known values."""

import hashlib
import math
import random
from statistics import NormalDist

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import normal
from tessera.operators import evaluation as E
from tessera.operators import families as G
from tessera.operators import inference as I
from tessera.operators import luck, residuals, tailwall

PANEL = "symbol string, t int, date date, o double, h double, l double, c double, v double, amount double"


def world(spark, days=40, names=36, book=8, seed=1):
    """A panel with a factor x and book columns b0.., holes in all of them, days on which a column is nearly missing."""
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(rng.normal(0, 0.02, (days, names)).cumsum(axis=0))
    b = rng.normal(size=(book, days, names)).cumsum(axis=1)
    b[1] = 2 * b[0] - 1  # ranks of a copy
    x = b[0] + 0.5 * b[2] + rng.normal(size=(days, names))
    for m in [x, *b]:
        m[rng.random(m.shape) < 0.004] = np.nan
    b[3][5, 4:] = np.nan
    x[7, :10] = np.nan
    cols = {"symbol": [f"s{j:03d}" for _ in range(days) for j in range(names)], "t": np.repeat(np.arange(days), names), "x": x.ravel(), **{f"b{i}": m.ravel() for i, m in enumerate(b)}}
    cols |= {"c": c.ravel(), "h": (c * 1.01).ravel(), "l": np.where(rng.random(c.shape) < 0.02, c * 1.01, c * 0.99).ravel()}
    pdf = pd.DataFrame(cols)
    df = spark.createDataFrame(pdf)
    return df.select("symbol", F.col("t").cast("int").alias("t"), *[F.when(~F.isnan(k), F.col(k)).alias(k) for k in pdf.columns[2:]]), x, b, c, pdf


def ranked(m):
    out = np.full(m.shape, np.nan)
    for t, row in enumerate(m):
        ok = ~np.isnan(row)
        if ok.sum() >= 30:
            out[t, ok] = (np.argsort(np.argsort(row[ok], kind="stable"), kind="stable") + 1) / (ok.sum() + 1)
    return out


@pytest.mark.parametrize("size", [0, 1, 2, 8])
def test_residuals_equal_least_squares(spark, size):
    df, x, b, *_ = world(spark)
    got = residuals.orthogonal_residual(df, ["x"], [f"b{i}" for i in range(size)]).toPandas()
    have = np.full(x.shape, np.nan)
    have[got["t"], got["symbol"].str[1:].astype(int)] = got["resid"].astype(float)
    r, books = ranked(x), [ranked(m) for m in b[:size]]
    want = r.copy()
    for t in range(len(r)):
        cols = [m[t] for m in books if (~np.isnan(m[t])).sum() >= 2]
        if not cols or (~np.isnan(r[t])).sum() < 30:
            continue
        a = np.column_stack([*cols, np.ones(len(r[t]))])
        ok = ~np.isnan(a).any(axis=1) & ~np.isnan(r[t])
        if ok.sum() < 30:
            continue
        beta, *_ = np.linalg.lstsq(a[ok], r[t][ok], rcond=None)
        want[t] = np.where(ok, 0, np.nan)
        want[t, ok] = r[t][ok] - a[ok] @ beta
    assert np.isnan(want[7]).all() and np.allclose(have, want, atol=1e-7, equal_nan=True)


def test_residual_metrics(spark):
    df, x, b, c, pdf = world(spark, days=60)
    row = residuals.residual_metrics(df, ["x", "b0"], ["b0", "b2"], 3).where("factor = 'x'").first()
    resid = residuals.orthogonal_residual(df, ["x"], ["b0", "b2"]).toPandas()
    m = np.full(x.shape, np.nan)
    m[resid["t"], resid["symbol"].str[1:].astype(int)] = resid["resid"].astype(float)
    fwd = np.full(c.shape, np.nan)
    fwd[:-3] = c[3:] / c[:-3] - 1
    moved = (pdf["h"] != pdf["l"]).to_numpy().reshape(c.shape)
    ics = []
    for t in range(len(m)):
        ok = moved[t] & ~np.isnan(m[t]) & ~np.isnan(fwd[t])
        if ok.sum() >= 30:
            ics.append(np.corrcoef(*[np.argsort(np.argsort(v[t][ok], kind="stable")) for v in (m, fwd)])[0, 1])
    means = np.array([np.nanmean(r) for r in m if not np.isnan(r).all()])
    assert row.days == len(ics) and row.resid_ic == pytest.approx(np.mean(ics))
    assert row.means == len(means) and row.resid_autocorr is None and np.abs(means).max() < 1e-12
    raw = df.where("x is not null").select(F.lit("x").alias("factor"), "t", "symbol", F.col("x").alias("resid"))
    means = np.nanmean(x, axis=1)
    assert residuals.mean_autocorrelation(raw).first().autocorr == pytest.approx(np.corrcoef(means[:-1], means[1:])[0, 1])
    none = residuals.residual_metrics(df, ["x"], [], 3).first()
    assert none.resid_ic is None and none.resid_autocorr is None
    assert residuals.orthogonal_residual(df.limit(0), ["x"], ["b0"]).count() == 0


def test_normal_functions():
    n, db = NormalDist(), duckdb.connect()
    for x in np.linspace(-6, 6, 41):
        assert db.sql(f"select {normal.upper_p(f'({x})')}").fetchall()[0][0] == pytest.approx(1 - n.cdf(x), rel=1e-9, abs=1e-15)
    for p in (1e-9, 0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 1 - 1e-6):
        assert db.sql(f"select {normal.quantile(f'({p})')}").fetchall()[0][0] == pytest.approx(n.inv_cdf(p), rel=2e-9, abs=1e-12)
    assert db.sql(f"select {normal.two_sided_p('-1.96')}").fetchall()[0][0] == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-13)
    assert db.sql(f"select {normal.expected_maximum('100')}").fetchall()[0][0] == pytest.approx(2.5306, abs=1e-3)
    assert db.sql(f"select {normal.expected_maximum('1')}, {normal.quantile('1.0')}").fetchall()[0] == (0, None)


def test_normals_do_not_depend_on_the_block():
    whole = luck.hashed_normals(1, np.arange(50), 0, 4000)
    assert np.array_equal(whole[10:20, 1000:1500], luck.hashed_normals(1, np.arange(10, 20), 1000, 1500))
    assert abs(whole.mean()) < 0.01 and abs(whole.std() - 1) < 0.01 and abs(np.corrcoef(whole[:, :2000].ravel(), whole[:, 2000:].ravel())[0, 1]) < 0.01
    assert np.abs(np.corrcoef(whole) - np.eye(50)).max() < 0.08


def sketches(m=30, n=80, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(3, n))
    return [list(map(float, base[i % 3] * (1 if i % 2 else -1) + 0.5 * rng.normal(size=n))) for i in range(m)]


def trials_of(spark, sk, extra=()):
    return spark.createDataFrame([(f"k{i:02d}", s) for i, s in enumerate([*sk, *extra])], "key string, sketch array<double>")


def correlated(sk, extra):
    x = np.array([s[-min(map(len, sk)) :] for s in sk])
    r = np.eye(len(sk) + extra)
    r[: len(sk), : len(sk)] = np.corrcoef(x)
    return r


def test_luck_equals_numpy(spark):
    sk = sketches()
    sk[0] = sk[0] + sk[0][:5]
    odd = [None, [1.0] * 80, [0.1] * 10, [float("nan")] * 80]
    vectors = luck.unit_tails(trials_of(spark, sk, odd)).cache()
    assert vectors.where("vec is null").count() == 4
    r = correlated(sk, 4)
    w, v = np.linalg.eigh(r)
    w = np.clip(w, 1e-8, None)
    x = np.random.default_rng(0).standard_normal((20_000, len(r))) @ (v * np.sqrt(w)).T
    for two, most in ((True, np.abs(x).max(axis=1)), (False, x.max(axis=1))):
        maxima = luck.draw_maxima(vectors, two_sided=two)
        row = luck.expected_maximum(maxima).first()
        assert row.draws == 20_000 and abs(row.bar - most.mean()) < 3 * math.hypot(row.se, most.std() / math.sqrt(len(most)))
    p = {r.key: r.p_fw for r in luck.family_p(maxima, spark.createDataFrame([("a", 2.0), ("b", None), ("c", 2.0), ("d", 9.0)], "key string, z double")).collect()}
    assert p["b"] is None and p["a"] == p["c"] == maxima.where("most >= 2").count() / 20_000 and p["d"] == 0
    assert luck.expected_maximum(luck.draw_maxima(vectors.limit(0))).first().bar == 0
    lam = np.linalg.eigvalsh(r)
    assert luck.spectral_count(vectors).first().m_eff == pytest.approx(lam.sum() ** 2 / (lam**2).sum())
    nu = {r.key: r.nu for r in luck.residual_shares(vectors).collect()}
    want = 1 / np.diag(np.linalg.inv(r + luck.RIDGE * np.eye(len(r))))
    assert [nu[f"k{i:02d}"] for i in range(len(r))] == pytest.approx(want, rel=1e-4)


def test_one_trial_more_never_lowers_the_bar(spark):
    sk, bars = sketches(12), []
    for m in (0, 1, 2, 6, 12):
        bars.append(luck.expected_maximum(luck.draw_maxima(luck.unit_tails(trials_of(spark, sk[:m])), 4000)).first().bar)
    assert bars == sorted(bars) and bars[0] == 0 and bars[1] == pytest.approx(math.sqrt(2 / math.pi), abs=0.03)


def test_projection_gives_correlations():
    rng = np.random.default_rng(3)
    r = np.clip(rng.uniform(0, 1, (40, 40)), 0, 1)
    r = (r + r.T) / 2
    np.fill_diagonal(r, 1)
    p = tailwall.project(r)
    assert np.linalg.eigvalsh(r).min() < -0.5 and np.linalg.eigvalsh(p).min() > -1e-9 and np.allclose(np.diag(p), 1)


def test_overlap_identities(spark):
    """The same list: 1; a chance overlap of c: 0; nothing in common: clipped to 0."""
    j = lambda w: w / (2 - w)
    rows = spark.createDataFrame([(1.0, 0.2), (j(0.2), 0.2), (0.0, 0.2), (j(0.6), 0.2), (1.5, 0.2)], "j double, c double")
    assert [r[0] for r in rows.select(tailwall.overlap_rho(F.col("j"), F.col("c"))).collect()] == pytest.approx([1, 0, 0, 0.5, 1])


def signed(spark, sigs, shares=None):
    return spark.createDataFrame([(i, s, 0.2) for i, s in enumerate(sigs)], "key long, sig array<long>, k_frac double")


def test_wall_lies_under_independence_and_rises(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 40, (4, 32))
    sigs = [[int(v) if rng.random() < 0.8 else int(rng.integers(0, 1 << 40)) for v in base[i % 4]] for i in range(24)]
    got = tailwall.wall(signed(spark, sigs), draws=8000).first()
    assert got.trials == 24 and 0.39 < got.emax < got.iid
    same = tailwall.wall(signed(spark, [sigs[0]] * 10), draws=8000).first()
    assert same.emax == pytest.approx(0, abs=0.02)
    alone = tailwall.wall(signed(spark, [None] * 10), draws=8000).first()
    assert alone.emax == pytest.approx(alone.iid, abs=0.05)
    assert tailwall.wall(signed(spark, []), draws=100).first().emax == 0
    monkeypatch.setattr(tailwall, "MOST", 5)
    assert tailwall.wall(signed(spark, sigs), draws=8000).first().emax == pytest.approx(got.iid, abs=0.05)


def slow_required(b, sr0, z):
    t = lambda s: (s - sr0) * math.sqrt(b["n"] - 1) / math.sqrt(max(1 - b["g3"] * s + (b["g4"] - 1) / 4 * s * s, 1e-8))
    lo, hi = 0.0, max(10.0, b["spread_ir"] * 2 + sr0 * 2 + 5)
    if t(hi) < z:
        return None
    for _ in range(80):
        lo, hi = (lo, (lo + hi) / 2) if t((lo + hi) / 2) >= z else ((lo + hi) / 2, hi)
    return hi


def test_deflation_and_admission(spark):
    kind = "key string, spread_ir double, g3 double, g4 double, n int, n_days int, s0_emp double, placebo_z double, placebo_gate double, noise_z double, net_ir double, net_g3 double, net_g4 double, net_n int"
    none = (None,) * 4
    blocks = [
        ("ok", 0.9, 0.1, 3.5, 90, 90, None, 4.0, None, 0.5, *none), ("legacy", 0.9, None, None, None, 90, 0.1, 4.0, None, 0.5, *none), ("weak", 0.2, 0.1, 3.5, 90, 90, None, 4.0, None, 0.5, *none),
        ("placebo", 0.9, 0.1, 3.5, 90, 90, None, 5.0, 2.0, 0.5, *none), ("noise", 0.9, 0.1, 3.5, 90, 90, None, 4.0, None, -3.0, *none), ("unknown", 0.9, 0.1, 3.5, 90, 90, None, 4.0, None, None, *none),
        ("none", None, 0.1, 3.5, 90, 90, None, 4.0, None, 0.5, *none), ("short", 0.9, 0.1, 3.5, 90, 9, None, 4.0, None, 0.5, *none), ("net", 0.9, 0.1, 3.5, 90, 90, None, 4.0, None, 0.5, 0.1, 0.0, 3.0, 90),
    ]
    df = spark.createDataFrame(blocks, kind)
    rng = np.random.default_rng(7)
    ledger = signed(spark, [[int(v) for v in rng.integers(0, 1 << 40, 32)] for _ in range(20)])
    gross = {r.key: r for r in tailwall.admission(df, ledger, draws=8000).collect()}
    assert {k: r.stop for k, r in gross.items()} == {
        "ok": None, "legacy": None, "weak": "deflation", "placebo": "placebo", "noise": "noise", "unknown": "noise_unknown", "none": "no_value", "short": "no_bar", "net": None,
    }
    assert gross["ok"].n_eff == gross["ok"].trials == 20 and gross["ok"].emax == pytest.approx(1.867, abs=0.05) and gross["ok"].sr0 == pytest.approx(gross["ok"].emax / math.sqrt(90))
    z = NormalDist().inv_cdf(1 - tailwall.ALPHA)
    assert gross["ok"].required == pytest.approx(slow_required({"n": 90, "g3": 0.1, "g4": 3.5, "spread_ir": 0.9}, gross["ok"].sr0, z))
    assert gross["legacy"].required == pytest.approx(gross["legacy"].emax * 0.1 + z * 0.1)
    assert gross["ok"].t_adj == pytest.approx((0.9 - gross["ok"].sr0) * math.sqrt(89) / math.sqrt(1 - 0.09 + 2.5 / 4 * 0.81))
    net = {r.key: r for r in tailwall.admission(df, ledger, draws=8000, net=True).collect()}
    assert (net["net"].basis, net["net"].stop, net["ok"].basis) == ("net", "deflation", "legacy")


def slow_union(sigs, need):
    parent = list(range(len(sigs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(sigs)):
        for j in range(i):
            if sigs[i] is not None and sigs[j] is not None and sum(a == b for a, b in zip(sigs[i], sigs[j])) >= need:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sigs))]


def test_signature_families_equal_union_find(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 20, (60, 32))
    sigs = []
    for i in range(2000):
        kin = int(rng.integers(0, 60)) if rng.random() < 0.6 else None
        keep = rng.random(32) < rng.choice([0.15, 0.25, 0.3, 0.6])
        sig = rng.integers(0, 1 << 40, 32)
        sigs.append(None if i % 97 == 0 else [int(v) for v in (np.where(keep, base[kin], sig) if kin is not None else sig)])
    got = {r.key: r.family for r in G.signature_components(signed(spark, sigs)).collect()}
    assert [got[i] for i in range(2000)] == slow_union(sigs, 8)
    assert G.signature_components(signed(spark, [None, None])).select("family").distinct().count() == 2


def test_components_of_a_path(spark):
    n = 200
    nodes = spark.range(n + 1).withColumnRenamed("id", "key")
    got = G.components(nodes, nodes.where(f"key < {n - 1}").select(F.col("key").alias("a"), (F.col("key") + 1).alias("b")))
    assert got.where("family = 0").count() == n and got.count() == n + 1


def slow_greedy(order, linked):
    lead = {}
    for i in order:
        lead[i] = next((j for j in order if lead.get(j) == j and (min(i, j), max(i, j)) in linked), i) if i not in lead else lead[i]
    return lead


def test_greedy_leaders_equal_the_loop(spark):
    rng = random.Random(4)
    for n, p in ((40, 0.1), (60, 0.3), (25, 0.0)):
        place = {i: rng.choice([0, 1, 2, 3]) for i in range(n)}
        linked = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < p}
        nodes = spark.createDataFrame([(i, v) for i, v in place.items()], "key long, place int")
        edges = spark.createDataFrame(list(linked) + [(0, 0)], "a long, b long")
        got = {r.key: r.lead for r in G.greedy_leaders(nodes, edges).collect()}
        assert got == slow_greedy(sorted(range(n), key=lambda i: (place[i], i)), linked)


def test_greedy_families_in_time(spark):
    sk = sketches(40, 60, seed=9)
    rows = [(f"k{i:02d}", None if i == 7 else f"2024-01-{1 + (i * 7) % 28:02d}", s) for i, s in enumerate(sk)]
    got = {r.key: (r.lead, r.depth, r.size) for r in G.greedy_families(spark.createDataFrame(rows, "key string, ts string, sketch array<double>")).collect()}
    order = [r[0] for r in sorted(rows, key=lambda r: (r[1] or "", r[0]))]
    corr = np.corrcoef(np.array(sk))
    linked = {(f"k{i:02d}", f"k{j:02d}") for i in range(40) for j in range(i + 1, 40) if abs(corr[i, j]) >= 0.6}
    want = slow_greedy(order, linked)
    assert {k: v[0] for k, v in got.items()} == want
    for k, (lead, depth, size) in got.items():
        kin = [o for o in order if want[o] == lead]
        assert (depth, size) == (kin.index(k) + 1, len(kin))


def test_strong_subset_and_admission(spark):
    factors = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.7), ("d", None)], "factor string, ir double")
    corr = spark.createDataFrame([("a", "b", -0.75), ("b", "c", 0.9), ("c", "d", 0.1)], "a string, b string, corr double")
    assert {r.factor: (r.kept, r.same_as) for r in G.strong_subset(factors, corr).collect()} == {"a": (True, None), "b": (False, "a"), "c": (True, None), "d": (True, None)}
    new = spark.createDataFrame([("n1", 0.5), ("n2", 0.5), ("n3", 0.95), ("n4", 0.5), ("n5", None)], "factor string, ir double")
    lib = spark.createDataFrame([("a", 0.9, True), ("b", 0.8, True), ("old", 0.1, False)], "factor string, ir double, active boolean")
    near = spark.createDataFrame([("n1", "a", 0.2), ("n2", "a", -0.8), ("b", "n3", 0.7), ("n4", "old", 0.995), ("n5", "b", 0.71), ("n5", "a", -0.71)], "a string, b string, corr double")
    got = {r.factor: (r.admit, r.reason, r.corr_max, r.most_similar, r.corr_raw) for r in G.admit(new, lib, near).collect()}
    assert got == {
        "n1": (True, "independent", 0.2, "a", 0.2), "n2": (False, "weaker", -0.8, "a", -0.8), "n3": (True, "stronger", 0.7, "b", 0.7),
        "n4": (False, "near_copy", None, None, 0.995), "n5": (False, "weaker", -0.71, "a", -0.71),
    }
    assert {r.reason for r in G.admit(new, lib.where("not active"), near).collect()} == {"first", "near_copy"}


@pytest.mark.parametrize("block", [2, 128])
def test_factor_correlations_in_blocks(spark, block):
    from tessera.operators.evaluation import factor_correlations

    df, x, b, *_ = world(spark, days=12, book=4)
    names = ["x", "b0", "b1", "b2", "b3"]
    got = {(r.a, r.b): (r["corr"], r.days) for r in factor_correlations(df, names, 2, block=block).collect()}
    shares = {k: pd.DataFrame(m).rank(axis=1, pct=True).to_numpy() for k, m in zip(names, [x, *b])}
    want = {}
    for i, p in enumerate(sorted(names)):
        for q in sorted(names)[i + 1 :]:
            cs = []
            for t in range(0, 12, 2):
                ok = ~np.isnan(shares[p][t]) & ~np.isnan(shares[q][t])
                if ok.sum() >= 30:
                    cs.append(np.corrcoef(shares[p][t][ok], shares[q][t][ok])[0, 1])
            want[p, q] = (pytest.approx(np.mean(cs)), len(cs))
    assert got == want and len(got) == 10


def test_placebo_hashes_a_name_once_for_all_factors(spark):
    rng = np.random.default_rng(8)
    cells = [(f, t, f"s{i}", float(i), float(rng.normal())) for f, n in (("a", 35), ("b", 40)) for t in (0, 5) for i in range(n)] + [("c", 0, f"s{i}", 1.0, 1.0) for i in range(29)]
    got = I.placebo(spark.createDataFrame(cells, "factor string, t int, symbol string, f double, fwd double"), 0.2, 4, 42)
    assert "md5" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for f, n, k in (("a", 35, 7), ("b", 40, 8)):
        for rep in range(4):
            days = []
            for t in (0, 5):
                own = [(hashlib.md5(f"42:{rep}:{t}:{s}".encode()).hexdigest(), r) for g, u, s, _, r in cells if g == f and u == t]
                days.append(np.mean([r for _, r in sorted(own)[:k]]) - np.mean([r for _, r in own]))
            want[f, rep] = np.mean(days)
    found = {(r.factor, r.rep): r.mean_ic for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - v) < 1e-12 for k, v in want.items())


def test_correlations_rank_inside_the_day(spark):
    """Two blocks, ties and holes; no window ranks the cells one factor at a time."""
    rng = np.random.default_rng(9)
    data = pd.DataFrame({k: rng.integers(0, 12, 80).astype(float) for k in ("a", "b", "c")})
    data.loc[rng.random(80) < 0.3, "b"] = np.nan
    rows = [(0, f"s{i}", *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(data.to_numpy())]
    got = E.factor_correlations(spark.createDataFrame(rows, "t int, symbol string, a double, b double, c double"), ["a", "b", "c"], 5, block=2)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    ranks = data.rank()
    found = {(r.a, r.b): (r.corr, r.days) for r in got.collect()}
    want = {(x, y): ranks[x].corr(ranks[y]) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))}
    assert found.keys() == want.keys() and all(abs(found[k][0] - v) < 1e-9 and found[k][1] == 1 for k, v in want.items())
