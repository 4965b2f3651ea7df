"""Queries over nulls, tails, regimes and multiple testing, and their DuckDB SQL, on the weekly panel."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions import normal
from ..operators import evaluation as E
from ..operators import inference as I
from ..sources.market import panel
from ..sources.panel import tradable
from ..sources.store import written
from .expr import evaluate
from .research_queries import _VALUED, D, FACTORS, H, STEP, daily, rounded, valid, valued

REPS, SEED, DRAWS, BAR = 200, 42, 60, 0.1
NAMES = list(FACTORS)


def regime_days(s, d):
    return I.regime_days(valued(s, d), NAMES, E.vol_regimes(panel(s, d)), H)


def block(s, d):
    return I.top_k_block(valid(s, d))


def beta_exposure(s, d):
    return I.exposure(I.beta_rolling(valued(s, d)), NAMES, "beta", STEP)


def short_ic(s, d):
    return E.day_ic(valued(s, d), NAMES, 2 * H, 2 * STEP, tradable())


def sampled(panel):
    """The sampled days of both factors with their returns, for queries that read them more than once."""
    d = panel.withColumn("fwd", E.forward_return(H)).where(F.col("t") % STEP == 0)
    return written(d.select("t", "date", "symbol", "fwd", "listed", "amount", *NAMES, *[c for c in d.columns if c == "beta"]), "sampled")


def real_and_cells(days):
    ic = written(E.valued_ic(days, NAMES, STEP, tradable()), "ic")
    return ic, ic.groupBy("factor").agg(F.avg("ic").alias("real_mean")), E.sampled_cells(days, NAMES, STEP, tradable())


def verdict(s, d):
    days = sampled(I.beta_rolling(valued(s, d)))
    ic, real, v = real_and_cells(days)
    return I.verdicts(E.ic_stats(ic), I.null_test(real, I.permuted_ic(v, REPS, SEED)), E.top_k_summary(E.top_k(v), 52 / STEP), I.exposure(days, NAMES, "beta", STEP), I.series_moments(ic), BAR)


def null_of(make, seed):
    def made(s, d):
        _, real, cells = real_and_cells(sampled(valued(s, d)))
        return tested(real, make(cells, REPS, seed))

    return made


def tested(real, null):
    """Without p, for which SQL has no function; z tells the same."""
    return rounded(I.null_test(real, null).drop("p"))


def causal(s, d):
    return I.leaks(panel(s, d), evaluate, FACTORS, ["o", "h", "l", "c", "v", "amount"], [100, 200, 300])


QUERIES = {
    "permutation_null": null_of(I.permuted_ic, SEED),
    "cyclic_permutation": null_of(I.rolled_ic, 123),
    "day_permutation": lambda s, d: rounded(I.alignment(I.day_permutation(valued(s, d), NAMES, H, STEP, tradable(), REPS, SEED))),
    "ordinal_ic": lambda s, d: rounded(I.ordinal_ic(valid(s, d))),
    "tail_block": lambda s, d: rounded(block(s, d).drop("held")),
    "tail_metrics": lambda s, d: rounded(I.tail_metrics(block(s, d))),
    "tail_placebo": lambda s, d: tested(block(s, d).groupBy("factor").agg(F.avg("spread").alias("real_mean")), I.placebo(valid(s, d), 0.2, DRAWS, SEED)),
    "selection_pairs": lambda s, d: rounded(I.selection_pairs(block(s, d))),
    "regime_ic": lambda s, d: rounded(I.regime_ic(regime_days(s, d))),
    "u_regime": lambda s, d: rounded(I.u_regime(I.regime_ic(regime_days(s, d)))),
    "u_regime_gated": lambda s, d: rounded(I.u_regime_gated(regime_days(s, d), E.vol_regimes(panel(s, d)))),
    "beta_rolling": lambda s, d: rounded(I.beta_rolling(panel(s, d)).select("symbol", "t", "beta")),
    "beta_exposure": lambda s, d: rounded(beta_exposure(s, d)),
    "region_stability": lambda s, d: rounded(I.region_stability(daily(s, d), "1996-01-01", "1996-03-10")),
    "deflated_sharpe": lambda s, d: rounded(I.deflated(I.series_moments(daily(s, d)), BAR)),
    "carving": lambda s, d: rounded(I.carving(daily(s, d))),
    "ic_quantiles": lambda s, d: rounded(I.quantiles(daily(s, d))),
    "aligned_pairs": lambda s, d: rounded(I.aligned_pairs(daily(s, d), 60)),
    "bucket_corr": lambda s, d: rounded(I.bucket_corr(daily(s, d), short_ic(s, d))),
    "verdicts": lambda s, d: rounded(verdict(s, d)),
    "causality": causal,
}

_r = lambda *cs: ", ".join(f"round({c}, {D}) AS {c}" for c in cs)
_REAL = "real AS (SELECT factor, avg(ic) AS real_mean FROM ic GROUP BY 1)"
_TEST = """g AS (SELECT factor, real_mean, avg(m) AS null_mean, stddev_pop(m) AS null_std, count(m) AS reps, count(*) FILTER (m >= real_mean) AS k FROM null_ JOIN real USING (factor) GROUP BY ALL),
test AS (SELECT factor, real_mean, null_mean, null_std, reps, CASE WHEN null_std > 0 THEN (real_mean - null_mean) / null_std END AS z, (k + 1) / (reps + 1) AS above FROM g)"""
_SHOW = f"SELECT factor, {_r('real_mean', 'null_mean', 'null_std')}, reps, {_r('z', 'above')} FROM test"
_REP = lambda n: f"(SELECT unnest(range({n})) AS rep)"
_COLUMN = f"""e AS (SELECT factor, rep, t, rf, rr, row_number() OVER (PARTITION BY factor, rep, t ORDER BY symbol) AS p, row_number() OVER (PARTITION BY factor, rep, t ORDER BY md5(concat_ws(':', '{SEED}', rep, t, symbol))) AS q FROM ranked, {_REP(REPS)}),
pi AS (SELECT a.factor, a.rep, a.t, corr(a.rf, b.rr) AS x FROM e a JOIN e b ON a.factor = b.factor AND a.rep = b.rep AND a.t = b.t AND a.p = b.q GROUP BY ALL), null_ AS (SELECT factor, rep, avg(x) AS m FROM pi GROUP BY ALL)"""
_BLOCK = """bp AS (SELECT *, greatest(1, CAST(round_even(n * 0.2, 0) AS INTEGER)) AS k, row_number() OVER (PARTITION BY factor, t ORDER BY f DESC, symbol DESC) AS rn FROM pooled),
bt AS (SELECT *, rank() OVER (PARTITION BY factor, t ORDER BY f) + (count(*) OVER (PARTITION BY factor, t, f) - 1) / 2.0 AS a, rank() OVER (PARTITION BY factor, t ORDER BY fwd) + (count(*) OVER (PARTITION BY factor, t, fwd) - 1) / 2.0 AS b FROM bp WHERE rn <= k),
bi AS (SELECT factor, t, CASE WHEN max(k) >= 4 AND stddev_samp(a) * stddev_samp(b) > 0 THEN corr(a, b) END AS tail_ic, list(symbol) AS held, avg(fwd) AS top FROM bt GROUP BY ALL),
bm AS (SELECT factor, t, max(k) AS k, avg(fwd) AS m FROM bp GROUP BY ALL),
bl AS (SELECT factor, t, k, top - m AS spread, tail_ic, held, lag(held) OVER (PARTITION BY factor ORDER BY t) AS prev FROM bi JOIN bm USING (factor, t)),
block AS (SELECT factor, t, k, spread, tail_ic, held, CASE WHEN prev IS NULL THEN 1.0::DOUBLE ELSE (len(held) + len(prev) - 2 * len(list_intersect(held, prev))) / (2.0 * k) END AS turn FROM bl)"""
_REGIME = f"""lr AS (SELECT *, coalesce(ln(CASE WHEN c > 0 THEN c END) - ln(lag(CASE WHEN c > 0 THEN c END) OVER (PARTITION BY symbol ORDER BY t)), 0) AS lr, abs(ln(c) - ln(lag(c, 1) OVER (PARTITION BY symbol ORDER BY t))) AS ar FROM panel),
rw AS (SELECT symbol, t, exp(sum(lr) OVER w) - 1 AS fwd, count(*) OVER w AS k FROM lr WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING)),
rc AS (SELECT f.factor, t, symbol, f.f, fwd FROM (SELECT v.t, v.symbol, rw.fwd, unnest([{{'factor': 'momentum', 'f': momentum}}, {{'factor': 'volume_z', 'f': volume_z}}]) AS f FROM valued v JOIN rw USING (symbol, t) JOIN panel p USING (symbol, t) WHERE k = {H} AND p.h <> p.l) WHERE f.f IS NOT NULL),
ro AS (SELECT factor, t, row_number() OVER (PARTITION BY factor, t ORDER BY f, symbol) AS a, row_number() OVER (PARTITION BY factor, t ORDER BY fwd, symbol) AS b FROM rc),
ri AS (SELECT factor, t, corr(a, b) AS ic FROM ro GROUP BY ALL HAVING count(*) >= 30),
vm AS (SELECT t, avg(ar) AS m FROM lr GROUP BY 1), vv AS (SELECT t, avg(m) OVER (ORDER BY t ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS vol FROM vm), vq AS (SELECT quantile_cont(vol, (1/3)::DOUBLE) AS a, quantile_cont(vol, (2/3)::DOUBLE) AS b FROM vv),
vr AS (SELECT t, CASE WHEN vol < a THEN 'low' WHEN vol < b THEN 'mid' ELSE 'high' END AS regime FROM vv, vq),
rs AS (SELECT factor, regime, CASE WHEN count(*) >= 10 THEN avg(ic) END AS mean, CASE WHEN count(*) >= 10 THEN stddev_samp(ic) END AS std, count(*) AS n FROM ri JOIN vr USING (t) GROUP BY ALL),
ru AS (SELECT factor, CASE WHEN count(mean) >= 2 THEN (max(mean) - min(mean)) * sqrt(sum(n) FILTER (mean IS NOT NULL)) END AS u, count(mean) AS regimes FROM rs GROUP BY 1)"""
_BETA = """br AS (SELECT symbol, t, c / lag(c, 1) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r FROM panel), bk AS (SELECT *, avg(r) OVER (PARTITION BY t) AS m FROM br),
bb AS (SELECT symbol, t, CASE WHEN count(r * m) OVER w >= 30 THEN avg(r * m) OVER w END AS rm, CASE WHEN count(r) OVER w >= 30 THEN avg(r) OVER w END AS ra, CASE WHEN count(m) OVER w >= 30 THEN avg(m) OVER w END AS ma, CASE WHEN count(m) OVER w >= 30 THEN avg(m * m) OVER w END AS mm
  FROM bk WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
beta AS (SELECT symbol, t, CASE WHEN mm - ma * ma <> 0 THEN (rm - ra * ma) / (mm - ma * ma) END AS beta FROM bb)"""
_EXPO = f"""xc AS (SELECT f.factor, t, symbol, f.f, beta FROM (SELECT v.t, v.symbol, beta, unnest([{{'factor': 'momentum', 'f': momentum}}, {{'factor': 'volume_z', 'f': volume_z}}]) AS f FROM valued v JOIN beta USING (symbol, t) WHERE v.t % {STEP} = 0 AND beta IS NOT NULL) WHERE f.f IS NOT NULL),
xr AS (SELECT factor, t, count(*) OVER (PARTITION BY factor, t) AS n, rank() OVER (PARTITION BY factor, t ORDER BY f) + (count(*) OVER (PARTITION BY factor, t, f) - 1) / 2.0 AS a, rank() OVER (PARTITION BY factor, t ORDER BY beta) + (count(*) OVER (PARTITION BY factor, t, beta) - 1) / 2.0 AS b FROM xc),
xi AS (SELECT factor, t, corr(a, b) AS x FROM xr WHERE n >= 30 GROUP BY ALL), expo AS (SELECT factor, avg(x) AS exposure, count(*) AS days FROM xi GROUP BY 1)"""
_MOM = """mo AS (SELECT factor, ic, avg(ic) OVER (PARTITION BY factor) AS mu FROM ic), mom AS (SELECT factor, avg(ic) / stddev_samp(ic) AS sr, avg((ic - mu) ^ 3) / stddev_samp(ic) ^ 3 AS g3, avg((ic - mu) ^ 4) / stddev_samp(ic) ^ 4 AS g4, count(*) AS n FROM mo GROUP BY 1)"""
_SIGS = ", ".join(f"min(md5(concat_ws(':', '{i}', key)))" for i in range(32))
ORACLES = {
    "permutation_null": f"{_VALUED}, {_REAL}, {_COLUMN}, {_TEST} {_SHOW}",
    "cyclic_permutation": f"""{_VALUED}, {_REAL}, e AS (SELECT factor, rep, t, rf, rr, n, row_number() OVER (PARTITION BY factor, rep, t ORDER BY symbol) - 1 AS p, CAST('0x' || substr(md5(concat_ws(':', '123', rep, t)), 1, 8) AS BIGINT) % n AS k FROM ranked, {_REP(REPS)}),
      pi AS (SELECT a.factor, a.rep, a.t, corr(a.rf, b.rr) AS x FROM e a JOIN e b ON a.factor = b.factor AND a.rep = b.rep AND a.t = b.t AND (a.p + a.k) % a.n = b.p GROUP BY ALL), null_ AS (SELECT factor, rep, avg(x) AS m FROM pi GROUP BY ALL), {_TEST} {_SHOW}""",
    "day_permutation": f"""{_VALUED}, fd AS (SELECT t, symbol, p.factor, p.f FROM (SELECT t, symbol, unnest([{{'factor': 'momentum', 'f': momentum}}, {{'factor': 'volume_z', 'f': volume_z}}]) AS p FROM valued WHERE t % {STEP} = 0 AND amount > 0) WHERE p.f IS NOT NULL),
      dd AS (SELECT DISTINCT t FROM panel), mv AS (SELECT rep, t AS u, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws(':', '{SEED}', rep, t)), t) - 1 AS t FROM dd, {_REP(REPS)} UNION ALL SELECT -1, t, t FROM dd),
      cl AS (SELECT x.factor, mv.rep, x.t, row_number() OVER (PARTITION BY x.factor, mv.rep, x.t ORDER BY x.f, x.symbol) AS a, row_number() OVER (PARTITION BY x.factor, mv.rep, x.t ORDER BY y.fwd, x.symbol) AS b FROM mv JOIN fd x ON x.t = mv.t JOIN valued y ON y.t = mv.u AND y.symbol = x.symbol WHERE y.fwd IS NOT NULL),
      pi AS (SELECT factor, rep, t, corr(a, b) AS x FROM cl GROUP BY ALL HAVING count(*) >= 2), ir AS (SELECT factor, rep, avg(x) / stddev_samp(x) AS ir FROM pi GROUP BY ALL HAVING count(*) >= 2),
      o AS (SELECT factor, ir AS observed FROM ir WHERE rep = -1),
      g AS (SELECT factor, observed, count(*) AS reps, avg(ir) AS null_mean, stddev_samp(ir) AS null_std, quantile_cont(ir, 0.05::DOUBLE) AS null_q5, quantile_cont(ir, 0.5::DOUBLE) AS null_q50, quantile_cont(ir, 0.95::DOUBLE) AS null_q95,
        100.0::DOUBLE * count(*) FILTER (ir < observed) / count(*) AS percentile, (1 + count(*) FILTER (ir >= observed)) / (count(*) + 1) AS p_upper, (1 + count(*) FILTER (ir <= observed)) / (count(*) + 1) AS p_lower FROM ir JOIN o USING (factor) WHERE rep >= 0 GROUP BY ALL),
      h AS (SELECT *, least(1, 2 * least(p_upper, p_lower)) AS p_two, CASE WHEN observed >= null_mean THEN p_upper ELSE p_lower END AS p_align FROM g)
      SELECT factor, {_r('observed')}, reps, {_r('null_mean', 'null_std', 'null_q5', 'null_q50', 'null_q95', 'percentile', 'p_upper', 'p_lower', 'p_two', 'p_align')}, p_align < 0.01 AS aligned FROM h""",
    "ordinal_ic": f"""{_VALUED}, o AS (SELECT factor, t, row_number() OVER (PARTITION BY factor, t ORDER BY f, symbol) AS a, row_number() OVER (PARTITION BY factor, t ORDER BY fwd, symbol) AS b FROM valid) SELECT factor, t, round(corr(a, b), {D}) AS ic FROM o GROUP BY ALL HAVING count(*) >= 2""",
    "tail_block": f"{_VALUED}, {_BLOCK} SELECT factor, t, k, {_r('spread', 'tail_ic', 'turn')} FROM block",
    "tail_metrics": f"""{_VALUED}, {_BLOCK}, c AS (SELECT *, spread - 2 * turn * 10.0 / 1e4 AS net, avg(spread) OVER (PARTITION BY factor) AS mu FROM block),
      g AS (SELECT factor, count(*) AS n, avg(spread) / stddev_samp(spread) AS spread_ir, avg(tail_ic) AS tail_ic, corr(spread, tail_ic) AS spread_ic_corr, avg((spread - mu) ^ 3) / stddev_samp(spread) ^ 3 AS g3, avg((spread - mu) ^ 4) / stddev_samp(spread) ^ 4 AS g4, avg(turn) AS turn, avg(spread) * 1e4 / (2 * avg(turn)) AS break_even_bps, avg(net) / stddev_samp(net) AS net_ir FROM c GROUP BY 1)
      SELECT factor, n, {', '.join(f'CASE WHEN n >= 10 THEN round({c}, {D}) END AS {c}' for c in ('spread_ir', 'tail_ic', 'spread_ic_corr', 'g3', 'g4', 'turn', 'break_even_bps', 'net_ir'))} FROM g""",
    "tail_placebo": f"""{_VALUED}, {_BLOCK}, real AS (SELECT factor, avg(spread) AS real_mean FROM block GROUP BY 1), e AS (SELECT factor, rep, t, k, fwd, row_number() OVER (PARTITION BY factor, rep, t ORDER BY md5(concat_ws(':', '{SEED}', rep, t, symbol))) AS q FROM bp, {_REP(DRAWS)}),
      pi AS (SELECT factor, rep, t, avg(fwd) FILTER (q <= k) - avg(fwd) AS x FROM e GROUP BY ALL), null_ AS (SELECT factor, rep, avg(x) AS m FROM pi GROUP BY ALL), {_TEST} {_SHOW}""",
    "selection_pairs": f"""{_VALUED}, {_BLOCK}, pk AS (SELECT factor, concat_ws(':', t, unnest(held)) AS key FROM block), sg AS (SELECT factor, count(*) AS n, [{_SIGS}] AS sig FROM pk GROUP BY 1),
      sh AS (SELECT x.factor AS a, y.factor AS b, count(*) AS m FROM pk x JOIN pk y ON x.key = y.key AND x.factor < y.factor GROUP BY ALL), j AS (SELECT a, b, m / (p.n + q.n - m) AS jaccard, len(list_filter(list_zip(p.sig, q.sig), lambda z: z[1] = z[2])) / 32.0 AS signature FROM sh JOIN sg p ON p.factor = a JOIN sg q ON q.factor = b)
      SELECT a, b, {_r('jaccard')}, round(CAST(signature AS DOUBLE), {D}) AS signature, round(2 * jaccard / (1 + jaccard), {D}) AS overlap FROM j""",
    "regime_ic": f"{_VALUED}, {_REGIME} SELECT factor, regime, {_r('mean', 'std')}, n FROM rs",
    "u_regime": f"{_VALUED}, {_REGIME} SELECT factor, {_r('u')}, regimes FROM ru",
    "u_regime_gated": f"""{_VALUED}, {_REGIME}, hs AS (SELECT factor, regime, t < (SELECT count(DISTINCT t) // 2 FROM vr) AS early, avg(ic) AS m, count(*) AS n FROM ri JOIN vr USING (t) GROUP BY ALL),
      hm AS (SELECT factor, r.regime, CASE WHEN max(n) FILTER (early) >= 10 THEN max(m) FILTER (early) END AS a, CASE WHEN max(n) FILTER (NOT early) >= 10 THEN max(m) FILTER (NOT early) END AS b, coalesce(max(n) FILTER (early), 0) AS na, coalesce(max(n) FILTER (NOT early), 0) AS nb FROM (SELECT DISTINCT regime FROM vr) r LEFT JOIN hs USING (regime) GROUP BY ALL),
      hc AS (SELECT *, a - avg(a) OVER (PARTITION BY factor) AS x, b - avg(b) OVER (PARTITION BY factor) AS y FROM hm WHERE factor IS NOT NULL),
      hg AS (SELECT factor, count(a) = (SELECT count(DISTINCT regime) FROM vr) AND count(b) = (SELECT count(DISTINCT regime) FROM vr) AS whole, sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0) AS cos, sqrt(sum(x * x)) AS nx, sqrt(sum(y * y)) AS ny, (max(a) - min(a)) * sqrt(greatest(sum(na), 1)) AS z_a, (max(b) - min(b)) * sqrt(greatest(sum(nb), 1)) AS z_b FROM hc GROUP BY 1),
      hj AS (SELECT *, CASE WHEN u IS NULL THEN 'none' WHEN NOT coalesce(whole, false) THEN 'too_few_days' WHEN nx < 1e-12 OR ny < 1e-12 THEN 'no_difference' WHEN cos <= 0 THEN 'direction' WHEN z_a < 2 OR z_b < 2 THEN 'size' ELSE 'passed' END AS gate FROM ru LEFT JOIN hg USING (factor))
      SELECT factor, CASE WHEN gate IN ('passed', 'none') THEN round(u, {D}) ELSE 0 END AS u, gate, {', '.join(f"CASE WHEN gate IN ('direction', 'size', 'passed') THEN round({c}, {D}) END AS {c}" for c in ('cos', 'z_a', 'z_b'))} FROM hj""",
    "beta_rolling": f"{_VALUED}, {_BETA} SELECT symbol, t, {_r('beta')} FROM beta",
    "beta_exposure": f"{_VALUED}, {_BETA}, {_EXPO} SELECT factor, {_r('exposure')}, days FROM expo",
    "region_stability": f"""{_VALUED}, e AS (SELECT off, CASE WHEN off <> 0 AND DATE '1996-01-01' + to_months(off) >= DATE '1996-03-10' THEN DATE '1996-03-09' ELSE CAST(DATE '1996-01-01' + to_months(off) AS DATE) END AS till FROM (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS off)),
      o AS (SELECT factor, off, count(*) AS n, CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) END AS ir FROM ic, e WHERE date < till GROUP BY ALL), g AS (SELECT factor, max(ir) FILTER (off = 0) AS base, min(ir) FILTER (off <> 0 AND n >= 10) AS lo, max(ir) FILTER (off <> 0 AND n >= 10) AS hi, count(*) FILTER (off <> 0 AND n >= 10) AS variants FROM o GROUP BY 1),
      h AS (SELECT *, (hi - lo) / abs(base) AS rel_spread FROM g)
      SELECT factor, {_r('base', 'lo', 'hi')}, variants, {_r('rel_spread')}, CASE WHEN variants = 0 THEN 'insufficient' WHEN base IS NULL OR base = 0 OR sign(lo) <> sign(base) OR sign(hi) <> sign(base) THEN 'sign_fragile' WHEN rel_spread >= 0.5 THEN 'magnitude_fragile' ELSE 'stable' END AS verdict FROM h""",
    "deflated_sharpe": f"""{_VALUED}, {_MOM}, t AS (SELECT *, (abs(sr) - {BAR}) * sqrt(n - 1) / sqrt(greatest(1e-8, 1 - g3 * sr + (g4 - 1) / 4 * sr * sr)) AS t FROM mom)
      SELECT factor, {_r('sr', 'g3', 'g4')}, n, {_r('t')}, t > {NormalDist().inv_cdf(0.95)!r} AS passes, round({1.96 * 1.96!r} / (sr * sr) / n, {D}) AS length_ratio FROM t""",
    "carving": f"""{_VALUED}, y AS (SELECT factor, year(date) AS y, avg(ic) AS m FROM ic GROUP BY ALL HAVING avg(ic) <> 0), g AS (SELECT factor, count(*) AS years, count(*) FILTER (m > 0) AS up FROM y GROUP BY 1),
      w AS (SELECT *, (SELECT sum(factorial(CAST(years AS INTEGER)) / (factorial(CAST(i AS INTEGER)) * factorial(CAST(years - i AS INTEGER)))) FROM range(0, least(up, years - up) + 1) r(i)) AS ways FROM g)
      SELECT factor, years, up, CASE WHEN years >= 3 THEN round(least(1.0, CAST(2 * ways AS DOUBLE) / pow(2, years)), {D}) END AS p FROM w""",
    "ic_quantiles": f"""{_VALUED}, q AS (SELECT factor, {', '.join(f'quantile_cont(ic, {p}::DOUBLE) AS p{round(p * 100)}' for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99))}, max(ic) AS most, avg(abs(ic)) AS mean_abs FROM ic GROUP BY 1) SELECT factor, {_r('p10', 'p25', 'p50', 'p75', 'p90', 'p99', 'most', 'mean_abs')}, round((p90 - p10) / 2.5631, {D}) AS pool_std FROM q""",
    "aligned_pairs": f"""{_VALUED}, p AS (SELECT a.factor AS a, b.factor AS b, a.ic AS x, b.ic AS y, row_number() OVER (PARTITION BY a.factor, b.factor ORDER BY a.t DESC) AS r FROM ic a JOIN ic b ON a.t = b.t AND a.factor < b.factor)
      SELECT a, b, round(covar_pop(x, y) / (stddev_samp(x) * stddev_samp(y)), {D}) AS corr, count(*) AS n FROM p WHERE r <= 60 GROUP BY ALL""",
    "verdicts": f"""{_VALUED}, {_REAL}, {_COLUMN}, {_TEST}, {_BETA}, {_EXPO}, {_MOM}, st AS (SELECT factor, avg(ic) / stddev_samp(ic) AS ir FROM ic GROUP BY 1), su AS (SELECT factor, avg(net) * 13.0 * 100 AS net_annual FROM topk GROUP BY 1),
      dt AS (SELECT factor, sr, n, CASE WHEN n >= 5 THEN (abs(sr) - {BAR}) * sqrt(n - 1) / sqrt(greatest(1e-8, 1 - g3 * sr + (g4 - 1) / 4 * sr * sr)) END AS t FROM mom),
      j AS (SELECT factor, ir, n, sr, z, net_annual, exposure, CASE WHEN t IS NOT NULL THEN {normal.upper_p('t')} END AS p, coalesce(abs(exposure) >= 0.3, false) AS beta,
        concat_ws(',', CASE WHEN abs(ir) > 5 THEN 'ir_too_high' END, CASE WHEN abs(ir) > 2 AND n < 40 THEN 'few_days_for_ir' END, CASE WHEN net_annual > 200 THEN 'net_too_high' END, CASE WHEN abs(sr) < {BAR} THEN 'under_the_bar' END) AS flags
        FROM st JOIN test USING (factor) LEFT JOIN su USING (factor) LEFT JOIN expo USING (factor) LEFT JOIN dt USING (factor)),
      k AS (SELECT *, CASE WHEN z IS NULL THEN 'no_z' WHEN abs(z) < 3 THEN 'z' WHEN beta THEN 'beta' WHEN n < 20 THEN 'days' WHEN p IS NULL THEN 'no_p' END AS refused FROM j)
      SELECT factor, {_r('ir')}, n, {_r('z', 'net_annual', 'exposure', 'p')}, flags, CASE WHEN p IS NULL THEN 'no_p' WHEN p > 0.05 THEN 'deflated_p' END AS warnings, refused, refused IS NULL AS accepted,
        CASE WHEN flags <> '' OR z IS NULL THEN 'needs_review' WHEN abs(z) < 3 THEN 'fail' WHEN beta THEN 'needs_review' ELSE 'pass' END AS verdict FROM k""",
    "causality": f"""{_VALUED} SELECT f AS factor, CAST(cut AS INTEGER) AS cut, count(CASE WHEN f = 'momentum' THEN momentum ELSE volume_z END) AS checked, 0::BIGINT AS changed, 0::BIGINT AS lost FROM valued, (SELECT unnest(['momentum', 'volume_z']) AS f), (SELECT unnest([100, 200, 300]) AS cut) WHERE t < cut GROUP BY ALL""",
}
_HALF = _VALUED.replace(f"lead(c, {H}) OVER s AS ch", f"lead(c, {2 * H}) OVER s AS ch").replace(f"t % {STEP} = 0", f"t % {2 * STEP} = 0")
ORACLES["bucket_corr"] = f"""WITH full_ AS ({_VALUED} SELECT factor, t, ic FROM ic), short_ AS ({_HALF} SELECT factor, t, ic FROM ic),
  a AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY t) - 1 AS i FROM full_), b AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY t) - 1 AS i FROM short_),
  k AS (SELECT factor, least(count(*), (SELECT count(*) FROM short_ s WHERE s.factor = f.factor)) AS k FROM full_ f GROUP BY 1),
  x AS (SELECT factor, ((i + 1) * k - 1) // (SELECT count(*) FROM full_ f WHERE f.factor = a.factor) AS g, avg(ic) AS x FROM a JOIN k USING (factor) GROUP BY ALL), y AS (SELECT factor, ((i + 1) * k - 1) // (SELECT count(*) FROM short_ s WHERE s.factor = b.factor) AS g, avg(ic) AS y FROM b JOIN k USING (factor) GROUP BY ALL)
  SELECT factor, round(corr(x, y), {D}) AS corr, count(*) AS buckets FROM x JOIN y USING (factor, g) GROUP BY 1"""
