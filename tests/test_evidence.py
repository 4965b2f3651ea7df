"""Segments, incubation, attribution, building blocks and structures against loops and brute force; verdict rules case by case."""

import hashlib
import itertools
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import attribution as A
from tessera.operators import inference as I
from tessera.operators import ledger as L
from tessera.operators import segments as S
from tessera.plans.expr import PlanError, check, parse

SEGMENTS = [("one", "2022-01-01", "2022-12-31"), ("two", "2023-01-01", "2023-12-31")]
N = NormalDist()


def dates():
    return [f"{y}-{m:02d}-{d:02d}" for y in (2022, 2023) for m in range(1, 13) for d in (3, 10, 17, 24)]


def slow_segments(factor, ds, vs, dev, version="segments-1", level=S.PASS_T):
    pool, weak, t, k = [], [], None, 0
    for k, (name, a, b) in enumerate(SEGMENTS, 1):
        own = [v * (1 if dev >= 0 else -1) for d, v in zip(ds, vs) if a <= d <= b]
        if len(own) < 3:
            return "stale", k, False, False, t, weak
        ir = np.mean(own) / np.std(own, ddof=1)
        if abs(dev) > 0 and ir < -S.DISASTER * abs(dev):
            return "reject", k, False, True, t, weak
        if ir < S.WEAK * abs(dev):
            weak = [*weak, name]
        pool += own
        t = np.mean(pool) / np.std(pool, ddof=1) * np.sqrt(len(pool))
        if t >= level + S.BAND:
            return "pass", k, False, False, t, weak
        if t > level - S.BAND:
            low, high = N.cdf(level - S.BAND), N.cdf(level + S.BAND)
            lot = int(hashlib.md5(f"{factor}:{version}:{k - 1}".encode()).hexdigest()[:8], 16) / 2**32
            if lot < (N.cdf(t) - low) / (high - low):
                return "pass", k, True, False, t, weak
    return "reject", k, False, False, t, weak


def test_segments_equal_the_fold(spark):
    rng, ds, rows, devs, want = np.random.default_rng(4), dates(), [], [], {}
    for i in range(120):
        dev, mean = float(rng.choice([0.5, -0.5, 0.3])), rng.choice([0, 0.2, 0.4, S.PASS_T / np.sqrt(96), -0.9, 0.7])
        vs = [float(mean * np.sign(dev) + x) for x in rng.normal(size=96)]
        use = ds[:96] if i % 20 else ds[:2]
        rows += [(f"f{i}", d, v) for d, v in zip(use, vs)]
        devs.append((f"f{i}", dev))
        want[f"f{i}"] = slow_segments(f"f{i}", use, vs[: len(use)], dev)
    got = S.judge_segments(spark.createDataFrame(rows, "factor string, date string, value double"), spark.createDataFrame([*devs, ("none", None)], "factor string, dev_ir double"), SEGMENTS)
    seen = {r.factor: (r.verdict, r.segments, r.randomized, r.disaster, r.t, list(r.weak)) for r in got.collect()}
    assert seen.keys() == want.keys()
    for k, (*a, t, weak) in want.items():
        *b, u, slack = seen[k]
        assert (a, weak) == (b, slack) and (u == pytest.approx(t) if t is not None else u is None)
    kinds = {(v[0], v[1], v[2], v[3]) for v in want.values()}
    assert {("pass", 1, False, False), ("reject", 1, False, True), ("reject", 2, False, False), ("stale", 1, False, False)} <= kinds and any(k[2] for k in kinds)


def test_incubation_in_three_batches_is_that_in_one(spark):
    rng = np.random.default_rng(8)
    ds = dates()
    rows = [(f, d, None if rng.random() < 0.1 else float(m + rng.normal())) for f, m in (("good", 0.8), ("bad", 0.0), ("turned", -0.8)) for d in ds] + [("short", d, 1.0 + i) for i, d in enumerate(ds[-10:])]
    days = spark.createDataFrame(rows, "factor string, date string, ic double")
    cohorts = spark.createDataFrame([("c", "good", 1, ds[10], 60), ("c", "bad", 1, ds[10], 60), ("c", "turned", -1, ds[10], 60), ("d", "good", 1, ds[10], 500), ("e", "short", 1, ds[-10], 10)], "cohort string, factor string, sign int, start string, window_days int")
    whole = {(r.cohort, r.factor): r for r in S.incubate(days, cohorts).collect()}
    state = None
    for a, b in ((0, 30), (30, 60), (60, 96)):
        state = S.add_days(state, days.where(F.col("date").isin(ds[a:b])), cohorts)
    for r in S.judge(state, cohorts).collect():
        w = whole[r.cohort, r.factor]
        assert (r.ready, r.n, r.survived) == (w.ready, w.n, w.survived) and (r.t is None) == (w.t is None) and (r.t is None or r.t == pytest.approx(w.t))
    good = [v for f, d, v in rows if f == "good" and d >= ds[10] and v is not None]
    assert whole["c", "good"].t == pytest.approx(np.mean(good) / np.std(good, ddof=1) * np.sqrt(len(good))) and whole["c", "good"].bar == pytest.approx(N.inv_cdf(1 - 0.0253 / 3))
    assert [whole[k].survived for k in (("c", "good"), ("c", "bad"), ("c", "turned"), ("e", "short"))] == [True, False, True, False]
    assert not whole["d", "good"].ready and whole["d", "good"].t is None


def test_legs():
    three = parse("add(add(cs_rank(c), negx(add(o, h))), v)")
    assert [str(A.part(three, p)) for p in A.legs(three)] == ["cs_rank(c)", "negx(add(o, h))", "v"]
    assert str(A.without(three, A.legs(three)[1])) == "add(add(cs_rank(c), zero), v)"
    assert A.legs(parse("cs_rank(add(o, h))")) == [] and A.block_names(three) == ["add", "add", "v", "cs_rank", "negx", "c", "add", "o", "h"]


def test_frequent_blocks_equal_brute_force(spark):
    rng = random.Random(3)
    held = {f"s{i}": {x for x in "abcdefgh" if rng.random() < 0.3 + 0.4 * (x in "abc")} for i in range(60)} | {f"t{i}": {"x", "y", "z", "w"} for i in range(12)}
    trials = spark.createDataFrame([(s,) for s in held for _ in range(2)] + [("none",)], "source_hash string")
    blocks = spark.createDataFrame([(s, x) for s, xs in held.items() for x in xs] + [("s1", None)], "source_hash string, block string")
    got = {(tuple(r["items"]), r.whole): r.n for r in A.frequent_blocks(trials, blocks).collect()}
    want = {}
    for k in (2, 3):
        for c in itertools.combinations("abcdefghwxyz", k):
            n = sum(set(c) <= xs for xs in held.values())
            if n >= 12:
                want[c, False] = n
    for s in {tuple(sorted(xs)) for xs in held.values()}:
        n = sum(tuple(sorted(xs)) == s for xs in held.values())
        if n >= 12:
            want[s, True] = n
    assert got == want and len(want) > 10


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_structures_equal_all_pairs(spark):
    rng = random.Random(5)
    tree = lambda d: rng.choice("ohlcv") if d == 0 or rng.random() < 0.2 else (f"ts_mean[{rng.choice([3, 5])}]({tree(d - 1)})" if rng.random() < 0.5 else f"add({tree(d - 1)}, {tree(d - 1)})")
    tokens = [A.block_names(parse(tree(3))) for _ in range(500)]
    trials = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)] + [(900, None), (901, [])], "key long, tokens array<string>")
    got = {(r.a, r.b): r.similarity for r in A.structure_links(trials, 0.8).collect()}
    want = {}
    for (i, x), (j, y) in itertools.combinations(enumerate(tokens), 2):
        jac = len(set(x) & set(y)) / len(set(x) | set(y))
        if jac >= 0.6 and (s := 0.6 * jac + 0.4 * (1 - edit(x, y) / max(len(x), len(y)))) >= 0.8 - 1e-12:
            want[i, j] = s
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items()) and len(want) > 100
    assert A.structure_links(trials.limit(0)).count() == 0
    with pytest.raises(ValueError):
        A.structure_links(trials, 0.4)


def test_verdict_rules(spark):
    """Flags first, then z, then beta; a missing beta is none, a missing p refuses, a missing z is for review."""
    cases = {
        "good": (0.5, 100, 5.0, 20.0, 0.1), "no_z": (0.5, 100, None, 20.0, 0.1), "weak_z": (0.5, 100, 2.0, 20.0, 0.1), "beta": (0.5, 100, 5.0, 20.0, -0.4), "no_beta": (0.5, 100, 5.0, 20.0, None),
        "small": (3.0, 30, 5.0, 20.0, 0.1), "absurd": (-6.0, 100, 5.0, 20.0, 0.1), "net": (0.5, 100, 5.0, 250.0, 0.1), "loss": (0.5, 100, 5.0, -250.0, 0.1), "short": (0.5, 15, 5.0, 20.0, 0.1), "tiny": (0.5, 4, 5.0, 20.0, 0.1), "bar": (0.05, 100, 5.0, 20.0, 0.1),
    }
    make = lambda i, name: spark.createDataFrame([(k, v[i]) for k, v in cases.items()], f"factor string, {name} double")
    stats = make(0, "ir").join(spark.createDataFrame([(k, v[1]) for k, v in cases.items()], "factor string, n long"), "factor")
    moments = make(0, "sr").withColumn("g3", F.lit(0.0)).withColumn("g4", F.lit(3.0))
    got = {r.factor: r for r in I.verdicts(stats, make(2, "z"), make(3, "net_annual"), make(4, "exposure").where("exposure is not null"), moments, 0.1).collect()}
    assert {k: r.verdict for k, r in got.items()} == {
        "good": "pass", "no_z": "needs_review", "weak_z": "fail", "beta": "needs_review", "no_beta": "pass", "small": "needs_review", "absurd": "needs_review", "net": "needs_review", "loss": "pass",
        "short": "pass", "tiny": "pass", "bar": "needs_review",
    }
    assert {k: r.refused for k, r in got.items()} == {
        "good": None, "no_z": "no_z", "weak_z": "z", "beta": "beta", "no_beta": None, "small": None, "absurd": None, "net": None, "loss": None, "short": "days", "tiny": "days", "bar": None,
    }
    assert got["tiny"].p is None and got["tiny"].warnings == "no_p" and got["bar"].warnings == "deflated_p"
    assert got["good"].p == pytest.approx(1 - N.cdf(0.4 * np.sqrt(99) / np.sqrt(1 + 0.5 * 0.25)), rel=1e-4)


def test_alignment_of_days(spark):
    """A factor that knows the next days' returns depends on the order of days; its rows' order alone does not."""
    rng = np.random.default_rng(2)
    names, days = 12, 60
    c = 100 * np.exp(rng.normal(0, 0.02, (days, names)).cumsum(axis=0))
    known = np.vstack([np.log(c[3:] / c[:-3]), np.zeros((3, names))]) + rng.normal(0, 0.02, (days, names))
    rows = [(f"s{j:02d}", t, float(c[t, j]), float(c[t, j]), float(known[t, j]), float(rng.normal())) for t in range(days) for j in range(names)]
    df = spark.createDataFrame(rows, "symbol string, t int, o double, c double, known double, noise double")
    irs = I.day_permutation(df, ["known", "noise"], 3, 3, F.lit(True), 200, 1)
    got = {r.factor: r for r in I.alignment(irs).collect()}
    assert got["known"].aligned and got["known"].p_upper == pytest.approx(1 / 201) and got["known"].percentile == 100 and not got["noise"].aligned
    assert got["known"].p_two == pytest.approx(2 / 201) and got["known"].null_q5 < got["known"].null_q50 < got["known"].null_q95
    assert irs.where("rep = -1 and factor = 'known'").first().ir == pytest.approx(got["known"].observed)


def test_one_regime_has_no_spread(spark):
    stats = spark.createDataFrame([("a", "low", 0.1, 0.1, 20), ("a", "mid", None, None, 5), ("b", "low", 0.1, 0.1, 20), ("b", "high", 0.3, 0.1, 30)], "factor string, regime string, mean double, std double, n long")
    assert {r.factor: (r.u, r.regimes) for r in I.u_regime(stats).collect()} == {"a": (None, 1), "b": (pytest.approx(0.2 * np.sqrt(50)), 2)}


def test_graph_families_join_under_an_absent_parent(spark):
    nodes = spark.createDataFrame([(1, None, 5), (2, 1, 3), (3, 99, 1), (4, 99, 2), (5, None, 9)], "id long, parent long, ts int")
    got = {r.id: (r.size, r.depth) for r in L.graph_families(nodes).collect()}
    assert got == {1: (2, 2), 2: (2, 1), 3: (2, 1), 4: (2, 2), 5: (1, 1)}


def test_spaces_are_checked():
    with pytest.raises(PlanError):
        check(parse("cs_rank(cs_rank(c))"), {"c"}, typed=True)


def test_block_permutation_keeps_blocks_and_rows(spark):
    """Slow numbers against the same orders by hand: blocks whole, the short last one too, z made anew."""
    from tessera.operators import series as Z

    rng = np.random.default_rng(3)
    n, h, reps = 403, 10, 25
    c, f = 100 * np.exp(rng.normal(0, 0.01, n).cumsum()), rng.normal(size=n).cumsum()
    df = spark.createDataFrame([("x", t, float(c[t]), float(c[t]), float(f[t])) for t in range(n)], "symbol string, t int, o double, c double, f double").withColumn("date", F.date_add(F.lit("2020-01-01"), F.col("t")))
    got = {r.rep: r for r in Z.block_permuted_ir(df, "f", h, reps, 9).collect()}

    def slow(v):
        p = []
        for t in range(0, n - h, h):
            w = v[max(0, t - 249) : t + 1]
            if len(w) >= 60:
                p.append((v[t] - w.mean()) / w.std(ddof=1) * (c[t + h] / c[t + 1] - 1))
        return np.mean(p) / np.std(p, ddof=1)

    assert got[-1].ir == pytest.approx(slow(f)) and len(got) == reps + 1
    blocks = [f[i : i + h] for i in range(0, n, h)]
    for rep in range(3):
        order = sorted(range(len(blocks)), key=lambda b: hashlib.md5(f"9:{rep}:{b}".encode()).hexdigest())
        assert got[rep].ir == pytest.approx(slow(np.concatenate([blocks[b] for b in order])))
    z = Z.block_test(Z.block_permuted_ir(df, "f", h, reps, 9)).first()
    assert z.reps == reps and z.z == pytest.approx((got[-1].ir - z.null_mean) / z.null_std)
    moved = {r["shift"]: r.ir for r in Z.shifted_products(df, "f", h).collect()}
    assert moved[0] == pytest.approx(slow(f)) and set(moved) == {0, 5, 10, 21}


def test_coverage_has_its_tier(spark):
    rows = [(lane, 5, i, 0.1) for lane, n in enumerate((399, 400, 799, 800)) for i in range(n)]
    got = L.coverage(spark.createDataFrame(rows, "lane int, horizon int, ts int, ic_ir double"))
    assert {r.lane: (r.trials, r.tier) for r in got.collect()} == {0: (399, "fresh"), 1: (400, "worn"), 2: (799, "worn"), 3: (800, "exhausted")}


def test_structures_by_bytes_equal_duckdb(spark):
    """Two swaps in a row are three changes of tokens, but four of bytes."""
    tokens = [["add", "p", "q", "x", "y"], ["add", "q", "p", "y", "x"], ["add", "p", "q", "y", "x"], ["add", "p", "q", "x", "y", "z"]]
    trials = spark.createDataFrame(list(enumerate(tokens)), "key long, tokens array<string>")
    got = {(r.a, r.b): round(r.similarity, 9) for r in A.structure_links(trials, 0.6, bytewise=True).collect()}
    letter = {t: chr(0x4E00 + i) for i, t in enumerate(sorted({t for x in tokens for t in x}))}
    want = {}
    for (i, x), (j, y) in itertools.combinations(enumerate(tokens), 2):
        far = edit(*("".join(letter[t] for t in z).encode() for z in (x, y)))
        want[i, j] = round(0.6 * len(set(x) & set(y)) / len(set(x) | set(y)) + 0.4 * (1 - far / max(len(x), len(y))), 9)
    assert got == {k: v for k, v in want.items() if v >= 0.6} and got[0, 1] == 0.68


def written_records(spark):
    """Records that stages of this session have written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_copies_of_a_structure_are_compared_once(spark):
    """600 keys of 12 lists: all pairs of keys are linked that should be, but what is shuffled grows with keys, not with pairs."""
    lists = [["add", "p", "q", x, y] for x in "abc" for y in "defg"]
    trials = spark.createDataFrame([(k, lists[k * 7 % 12]) for k in range(600)], "key long, tokens array<string>")
    alike = {}
    for (i, x), (j, y) in itertools.product(enumerate(lists), repeat=2):
        alike[i, j] = 0.6 * len(set(x) & set(y)) / len(set(x) | set(y)) + 0.4 * (1 - edit(x, y) / 5)
    want = {(a, b): s for a, b in itertools.combinations(range(600), 2) if (s := alike[a * 7 % 12, b * 7 % 12]) >= 0.7}
    before = written_records(spark)
    rows = A.structure_links(trials).collect()
    assert written_records(spark) - before < 20 * 600
    assert len(rows) == len(want) > 80_000 and {(r.a, r.b): round(r.similarity, 9) for r in rows} == {k: round(s, 9) for k, s in want.items()}
    tiled = A.structure_links(trials, tile=7).collect()
    assert len(tiled) == len(rows) and set(tiled) == set(rows)
