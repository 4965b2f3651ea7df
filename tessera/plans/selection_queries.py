"""Queries over residuals, selection luck, the tail wall and families, and their DuckDB SQL: trials are factors of the weekly panel, and a trail from ``events``."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions import normal
from ..operators import evaluation as E
from ..operators import families as G
from ..operators import inference as I
from ..operators import ledger as L
from ..operators import luck, residuals, tailwall
from ..sources.market import panel
from ..sources.panel import tradable
from ..sources.store import written
from .expr import evaluate
from .ledger_queries import _LAST, trail
from .research_queries import _VALUED, D, H, STEP, rounded

#: Trials that real research would make: one idea over several windows, its mirror image, and others.
SIZES = {"mom": (5, 10, 20), "pos": (5, 10, 20), "volz": (10, 20, 60), "amtz": (10, 20, 60)}
SHAPES = {"mom": "ts_momentum[{w}](c)", "pos": "ts_range_pos[{w}](c)", "volz": "ts_zscore[{w}](v)", "amtz": "ts_zscore[{w}](amount)"}
TRIALS = {f"{name}{w}": SHAPES[name].format(w=w) for name, sizes in SIZES.items() for w in sizes}
TRIALS |= {"rev5": "negx(ts_momentum[5](c))", "rev20": "negx(ts_momentum[20](c))"}
POINTS, BAR = 40, 0.25


def factors(s, d):
    return evaluate(panel(s, d), TRIALS)


def trial_cells(s, d):
    return E.cells(factors(s, d), list(TRIALS), H, STEP, tradable())


def trial_ic(s, d):
    return E.day_ic(factors(s, d), list(TRIALS), H, STEP, tradable())


def sampled_factors(s, d):
    """The sampled days of all trials with their returns, for queries that read them more than once."""
    valued = factors(s, d).withColumn("fwd", E.forward_return(H)).where(F.col("t") % STEP == 0)
    return written(valued.select("t", "date", "symbol", "fwd", "listed", "amount", *TRIALS), "factors")


def ir_and_correlations(s, d):
    valued = sampled_factors(s, d)
    ir = written(E.ic_stats(E.valued_ic(valued, list(TRIALS), STEP, tradable())).select("factor", "ir"), "ir")
    return ir, written(E.factor_correlations(valued, list(TRIALS), STEP), "corr")


def family_p(s, d):
    ic = written(trial_ic(s, d), "ic")  # read by the sketches and the scores
    z = E.ic_stats(ic).select(F.col("factor").alias("key"), (F.abs("ir") * F.sqrt("n")).alias("z"))
    return luck.family_p(luck.draw_maxima(luck.unit_tails(sketched(ic), POINTS)), z)


def sketches(s, d):
    return sketched(trial_ic(s, d))


def sketched(ic):
    made = ic.groupBy(F.col("factor").alias("key")).agg(F.array_sort(F.collect_list(F.struct("t", "ic"))).alias("c")).select("key", F.col("c.ic").alias("sketch"))
    return written(made, "sketches")  # read several times


def tails(s, d):
    return luck.unit_tails(sketches(s, d), POINTS)


def signed(signatures):
    made = signatures.select(F.col("factor").alias("key"), "sig", F.lit(0.2).alias("k_frac"))
    return written(made, "signatures")  # read several times


def top_days(s, d, width=0):
    return I.top_k_days(factors(s, d), list(TRIALS), H, STEP, tradable(), width=width)


def signatures(s, d):
    return signed(I.least_by_place(top_days(s, d, 32), 32))


def signed_trail(s, d):
    last = L.latest(trail(s, d), "source_hash", "horizon")
    return written(last.select(F.concat_ws(":", "source_hash", F.col("horizon").cast("string")).alias("key"), "ts", F.col("mh").alias("sig"), "sketch", "horizon"), "trail")


def residual_of(book):
    return lambda s, d: rounded(residuals.orthogonal_residual(factors(s, d), ["mom20"], book).select("factor", "t", "symbol", "resid"))


def admission(s, d):
    cells = written(trial_cells(s, d), "cells")
    block = written(I.top_k_block(cells), "block")  # read by the spreads and the signatures
    return tailwall.admission(spread_blocks(cells, block), signed(I.selection_signature(block)))


def spread_blocks(cells, block):
    """What a tail judgement takes of each trial: spread and its moments, days, and the placebo's z."""
    m = I.tail_metrics(block).where("spread_ir is not null")
    real = block.groupBy("factor").agg(F.avg("spread").alias("real_mean"))
    z = I.null_test(real, I.placebo(cells, 0.2, 60, 42)).select("factor", "z")
    none = F.lit(None).cast("double")
    return m.join(z, "factor").select(
        F.col("factor").alias("key"), "spread_ir", "g3", "g4", F.col("n").cast("int").alias("n"), F.col("n").cast("int").alias("n_days"), none.alias("s0_emp"), F.col("z").alias("placebo_z"), none.alias("placebo_gate"),
        F.lit(0.0).alias("noise_z"), "net_ir", none.alias("net_g3"), none.alias("net_g4"), F.lit(None).cast("int").alias("net_n"),
    )


def fixed_deflation(s, d):
    none = F.lit(None).cast("double")  # no turnover and no order within the best k is asked for
    m = I.tail_metrics(top_days(s, d).withColumns({"tail_ic": none, "turn": none})).where("spread_ir is not null")
    b = m.select("factor", "spread_ir", "g3", "g4", "n", F.col("n").alias("n_days"), F.lit(None).cast("double").alias("s0_emp"))
    return rounded(tailwall.deflation(b, F.lit(0.0), fixed=F.lit(BAR)).select("factor", "spread_ir", "n", "sr0", "t_adj", "pass_g3", "required"))


def strong(s, d):
    return G.strong_subset(*ir_and_correlations(s, d))


def admitted(s, d):
    """Momentum and volume trials against a library of the others, every second of them active."""
    ir, corr = ir_and_correlations(s, d)
    new = F.col("factor").rlike("^(mom|volz)")
    return rounded(G.admit(ir.where(new), ir.where(~new).withColumn("active", ~F.col("factor").rlike("5$")), corr))


QUERIES = {
    "residual_one_factor": residual_of(["volz20"]),
    "residual_two_factors": residual_of(["volz20", "pos10"]),
    "residual_metrics": lambda s, d: rounded(residuals.residual_metrics(factors(s, d), ["mom20", "volz10"], ["pos10"], H)),
    "selection_luck": lambda s, d: rounded(luck.expected_maximum(luck.draw_maxima(tails(s, d)))),
    "luck_family_p": lambda s, d: rounded(family_p(s, d)),
    "luck_spectral_count": lambda s, d: rounded(luck.spectral_count(tails(s, d))),
    "luck_residual_shares": lambda s, d: rounded(luck.residual_shares(tails(s, d))),
    "trial_counted_bar": lambda s, d: rounded(tailwall.counted_bar(G.signature_components(signatures(s, d)))),
    "trial_families": lambda s, d: G.signature_components(signatures(s, d)),
    "ledger_signature_families": lambda s, d: G.signature_components(signed_trail(s, d), 0.75),
    "ledger_sketch_families": lambda s, d: G.greedy_families(signed_trail(s, d).where("horizon = 5"), 0.6),
    "tail_wall": lambda s, d: rounded(tailwall.wall(signatures(s, d))),
    "tail_deflation": fixed_deflation,
    "tail_admission": lambda s, d: rounded(admission(s, d)),
    "strong_subset": strong,
    "library_admission": admitted,
}

_STRUCTS = ", ".join(f"{{'factor': '{k}', 'f': {k}}}" for k in TRIALS)


def _columns() -> str:
    out = []
    for name, w in ((name, w) for name, sizes in SIZES.items() for w in sizes):
        least = max(2, w // 2)
        over = f"OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        x = {"volz": "v", "amtz": "amount"}.get(name, "c")
        shape = {"mom": f"c / lag(c, {w}) OVER s - 1", "pos": f"CASE WHEN count(c) {over} >= {least} THEN (c - min(c) {over}) / greatest(max(c) {over} - min(c) {over}, 1e-12) END"}
        z = f"CASE WHEN count({x}) {over} >= {least} THEN ({x} - avg({x}) {over}) / greatest(stddev_samp({x}) {over}, 1e-12) END"
        out.append(f"{shape.get(name, z)} AS {name}{w}")
    return ", ".join(out)


_FACTORS = f"""{_VALUED}, many AS (SELECT *, -mom5 AS rev5, -mom20 AS rev20 FROM (SELECT symbol, t, date, o, h, l, c, amount, lead(c, {H}) OVER s / lead(o, 1) OVER s - 1 AS fwd, {_columns()} FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY t)))"""
_CELLS = f"""{_FACTORS}, tc AS (SELECT *, count(*) OVER (PARTITION BY factor, t) AS n FROM (SELECT t, symbol, fwd, p.factor, p.f FROM (SELECT t, symbol, fwd, unnest([{_STRUCTS}]) AS p FROM many WHERE t % {STEP} = 0 AND amount > 0 AND fwd IS NOT NULL) WHERE p.f IS NOT NULL)),
tp AS (SELECT * FROM tc WHERE n >= 30),
tr AS (SELECT *, rank() OVER (PARTITION BY factor, t ORDER BY f) + (count(*) OVER (PARTITION BY factor, t, f) - 1) / 2.0 AS a, rank() OVER (PARTITION BY factor, t ORDER BY fwd) + (count(*) OVER (PARTITION BY factor, t, fwd) - 1) / 2.0 AS b FROM tp),
tic AS (SELECT factor, t, corr(a, b) AS ic FROM tr GROUP BY ALL HAVING stddev_samp(a) * stddev_samp(b) > 0),
tb AS (SELECT *, greatest(1, CAST(round_even(n * 0.2, 0) AS INTEGER)) AS k, row_number() OVER (PARTITION BY factor, t ORDER BY f DESC, symbol DESC) AS rn FROM tp),
tk AS (SELECT factor, concat_ws(':', t, symbol) AS key FROM tb WHERE rn <= k),
ts_ AS (SELECT factor, avg(fwd) FILTER (rn <= k) - avg(fwd) AS spread FROM tb GROUP BY factor, t),
tm AS (SELECT factor, count(*) AS n, avg(spread) / stddev_samp(spread) AS spread_ir, avg((spread - mu) ^ 3) / stddev_samp(spread) ^ 3 AS g3, avg((spread - mu) ^ 4) / stddev_samp(spread) ^ 4 AS g4 FROM (SELECT *, avg(spread) OVER (PARTITION BY factor) AS mu FROM ts_) GROUP BY 1 HAVING count(*) >= 10)"""
_SIGS = ", ".join(f"min(md5(concat_ws(':', '{i}', key)))" for i in range(32))
_CLOSE = "len(list_filter(list_zip(p.sig, q.sig), lambda z: z[1] = z[2]))"
_SPREAD = """, walk AS (SELECT key, key AS family FROM nodes UNION SELECT links.b, walk.family FROM walk JOIN links ON links.a = walk.key)"""
_COMPONENTS = lambda nodes, need: f""", nodes AS ({nodes}), links AS (SELECT p.key AS a, q.key AS b FROM nodes p JOIN nodes q ON p.key <> q.key AND {_CLOSE} >= {need}){_SPREAD},
families AS (SELECT key, min(family) AS family FROM walk GROUP BY 1)"""  # noqa: E731
_RECURSIVE = lambda sql: "WITH RECURSIVE" + sql.lstrip()[4:]
_ROUND = lambda *cs: ", ".join(f"round({c}, {D}) AS {c}" for c in cs)
_ORDINAL = lambda x: f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER (PARTITION BY t) >= 30 THEN row_number() OVER (PARTITION BY t ORDER BY {x} NULLS LAST, symbol) / (count({x}) OVER (PARTITION BY t) + 1) END"
_RANKS = lambda x, *book: f"{_FACTORS}, rk AS (SELECT t, symbol, {_ORDINAL(x)} AS x, {', '.join(f'{_ORDINAL(b)} AS z{i}' for i, b in enumerate(book))} FROM many)"
_FIT = lambda m: f"fit AS (SELECT *, {' OR '.join(f'count(z{i}) OVER (PARTITION BY t) > 0' for i in range(m))} AS any_, {' AND '.join(f'(z{i} IS NOT NULL OR count(z{i}) OVER (PARTITION BY t) = 0)' for i in range(m))} AS whole FROM rk)"
_ONE = """g AS (SELECT t, count(*) AS n, avg(x) AS mx, avg(z0) AS m0, CASE WHEN var_pop(z0) > 0 THEN covar_pop(x, z0) / var_pop(z0) ELSE 0 END AS b0 FROM fit WHERE whole AND x IS NOT NULL GROUP BY 1),
resid AS (SELECT '{f}' AS factor, t, symbol, CASE WHEN NOT any_ OR coalesce(n < 30, true) THEN x WHEN whole THEN x - mx - b0 * coalesce(z0 - m0, 0) END AS resid FROM fit LEFT JOIN g USING (t) WHERE x IS NOT NULL)"""
_TWO = """c AS (SELECT t, count(*) AS n, avg(x) AS mx, coalesce(avg(z0), 0) AS m0, coalesce(avg(z1), 0) AS m1, coalesce(var_pop(z0), 0) AS v0, coalesce(var_pop(z1), 0) AS v1, coalesce(covar_pop(z0, z1), 0) AS c01, coalesce(covar_pop(x, z0), 0) AS x0, coalesce(covar_pop(x, z1), 0) AS x1 FROM fit WHERE whole AND x IS NOT NULL GROUP BY 1),
g AS (SELECT *, v0 * v1 - c01 * c01 AS det FROM c),
resid AS (SELECT '{f}' AS factor, t, symbol, CASE WHEN NOT any_ OR coalesce(n < 30, true) THEN x WHEN whole AND det > 1e-12 THEN x - mx - (x0 * v1 - x1 * c01) / det * (z0 - m0) - (x1 * v0 - x0 * c01) / det * (z1 - m1)
  WHEN whole AND v0 > 0 THEN x - mx - x0 / v0 * (z0 - m0) WHEN whole AND v1 > 0 THEN x - mx - x1 / v1 * (z1 - m1) WHEN whole THEN x - mx END AS resid FROM fit LEFT JOIN g USING (t) WHERE x IS NOT NULL)"""
_SHOW = f"SELECT factor, t, symbol, {_ROUND('resid')} FROM resid"


def _metrics(f: str) -> str:
    return f"""({_RANKS(f, 'pos10')}, {_FIT(1)}, {_ONE.format(f=f)},
      st AS (SELECT symbol, t, h, l, coalesce(ln(CASE WHEN c > 0 THEN c END) - ln(lag(CASE WHEN c > 0 THEN c END) OVER (PARTITION BY symbol ORDER BY t)), 0) AS lr FROM panel),
      aw AS (SELECT symbol, t, h, l, exp(sum(lr) OVER w) - 1 AS fwd, count(*) OVER w AS k FROM st WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING)),
      rc AS (SELECT t, symbol, resid, fwd, count(*) OVER (PARTITION BY t) AS n FROM resid JOIN aw USING (symbol, t) WHERE k = {H} AND h <> l AND resid IS NOT NULL),
      ro AS (SELECT t, row_number() OVER (PARTITION BY t ORDER BY resid, symbol) AS a, row_number() OVER (PARTITION BY t ORDER BY fwd, symbol) AS b FROM rc WHERE n >= 30),
      ri AS (SELECT t, corr(a, b) AS ic FROM ro GROUP BY 1), mean AS (SELECT t, avg(resid) AS a FROM resid WHERE resid IS NOT NULL GROUP BY 1), lagged AS (SELECT a, lead(a) OVER (ORDER BY t) AS b FROM mean)
      SELECT '{f}' AS factor, (SELECT CASE WHEN count(*) >= 10 THEN round(avg(ic), {D}) END FROM ri) AS resid_ic, (SELECT count(*) FROM ri) AS days,
        (SELECT CASE WHEN count(*) >= 20 AND stddev_pop(a) FILTER (b IS NOT NULL) * stddev_pop(b) >= 1e-12 THEN round(corr(a, b), {D}) END FROM lagged) AS resid_autocorr, (SELECT count(*) FROM mean) AS means)"""


def _greedy(nodes: str, linked: str) -> str:
    """Through the nodes one by one: each is led by the first leader linked to it. ``nodes`` gives (key, i) with i from 1."""
    return f""", nodes AS ({nodes}), pairs AS (SELECT p.i AS pi, q.i AS qi FROM nodes p JOIN nodes q ON p.i > q.i AND ({linked})),
walk(i, leaders, lead) AS (SELECT 0::BIGINT, CAST([] AS BIGINT[]), NULL::BIGINT UNION ALL
  SELECT n.i, CASE WHEN m IS NULL THEN list_append(leaders, n.i) ELSE leaders END, coalesce(m, n.i) FROM (SELECT walk.i + 1 AS i, leaders, list_min(list_intersect(leaders, (SELECT list(qi) FROM pairs WHERE pi = walk.i + 1))) AS m FROM walk) n JOIN nodes USING (i))"""


_NAMED = f"SELECT factor AS key, row_number() OVER (ORDER BY ir DESC NULLS LAST, factor) AS i FROM (SELECT factor, avg(ic) / stddev_samp(ic) AS ir FROM tic GROUP BY 1)"  # noqa: F541
_CORR = f"""fr AS (SELECT p.factor, t, symbol, p.f, rank() OVER (PARTITION BY p.factor, t ORDER BY p.f) + (count(*) OVER (PARTITION BY p.factor, t, p.f) - 1) / 2.0 AS r FROM (SELECT t, symbol, unnest([{_STRUCTS}]) AS p FROM many WHERE t % {STEP} = 0) WHERE p.f IS NOT NULL),
fd AS (SELECT x.factor AS a, y.factor AS b, x.t, CASE WHEN stddev_samp(x.r) * stddev_samp(y.r) > 0 THEN corr(x.r, y.r) END AS c FROM fr x JOIN fr y ON x.t = y.t AND x.symbol = y.symbol AND x.factor < y.factor GROUP BY ALL HAVING count(*) >= 30),
fc AS (SELECT a, b, avg(c) AS corr FROM fd WHERE c IS NOT NULL GROUP BY ALL)"""
_UNIT = f"""sk AS (SELECT factor, list(ic ORDER BY t) AS s FROM tic GROUP BY 1), ln_ AS (SELECT min(len(s)) AS n FROM sk WHERE len(s) >= {POINTS}), ut AS (SELECT factor, CASE WHEN len(s) >= {POINTS} THEN s[len(s) - n + 1:] END AS v FROM sk, ln_)"""
_Z = NormalDist().inv_cdf(1 - tailwall.ALPHA)
ORACLES = {
    "residual_one_factor": f"{_RANKS('mom20', 'volz20')}, {_FIT(1)}, {_ONE.format(f='mom20')} {_SHOW}",
    "residual_two_factors": f"{_RANKS('mom20', 'volz20', 'pos10')}, {_FIT(2)}, {_TWO.format(f='mom20')} {_SHOW}",
    "residual_metrics": f"{_metrics('mom20')} UNION ALL {_metrics('volz10')}",
    "luck_spectral_count": f"""{_CELLS}, {_UNIT}, pr AS (SELECT p.factor, q.factor, CASE WHEN p.factor = q.factor THEN 1 WHEN p.v IS NULL OR q.v IS NULL THEN 0 ELSE (SELECT corr(z[1], z[2]) FROM (SELECT unnest(list_zip(p.v, q.v)) AS z)) END AS r FROM ut p, ut q)
      SELECT (SELECT count(*) FROM ut) AS trials, round((SELECT count(*) FROM ut) ^ 2 / sum(r * r), {D}) AS m_eff FROM pr""",
    "trial_families": _RECURSIVE(f"{_CELLS}{_COMPONENTS(f'SELECT factor AS key, [{_SIGS}] AS sig FROM tk GROUP BY 1', 8)} SELECT key, family FROM families"),
    "trial_counted_bar": _RECURSIVE(f"{_CELLS}{_COMPONENTS(f'SELECT factor AS key, [{_SIGS}] AS sig FROM tk GROUP BY 1', 8)}, q AS (SELECT count(DISTINCT family) AS n_eff, count(*) AS trials FROM families) SELECT n_eff, trials, round({normal.expected_maximum('n_eff')}, {D}) AS emax FROM q"),
    "ledger_signature_families": _RECURSIVE(f"WITH {_LAST}{_COMPONENTS(chr(32).join(['SELECT concat_ws(chr(58), source_hash, horizon) AS key, mh AS sig FROM last']), 6)} SELECT key, family FROM families"),
    "ledger_sketch_families": _RECURSIVE(f"""WITH {_LAST}{_greedy("SELECT concat_ws(':', source_hash, horizon) AS key, ts, sketch, row_number() OVER (ORDER BY ts, concat_ws(':', source_hash, horizon)) AS i FROM last WHERE horizon = 5", "abs((SELECT corr(z[1], z[2]) FROM (SELECT unnest(list_zip(p.sketch, q.sketch)) AS z))) >= 0.6")}
      SELECT n.key, m.key AS lead, CAST(row_number() OVER (PARTITION BY w.lead ORDER BY n.i) AS INTEGER) AS depth, count(*) OVER (PARTITION BY w.lead) AS size FROM walk w JOIN nodes n ON n.i = w.i JOIN nodes m ON m.i = w.lead"""),
    "tail_deflation": f"""{_CELLS}, dn AS (SELECT *, (spread_ir - {BAR}) * sqrt(n - 1) / sqrt(greatest(1 - g3 * spread_ir + (g4 - 1) / 4 * spread_ir ^ 2, 1e-8)) AS t_adj, {_Z * _Z!r} / (n - 1) AS q FROM tm),
      ro AS (SELECT *, 1 - q * (g4 - 1) / 4 AS qa, -2 * {BAR} + q * g3 AS qb, {BAR * BAR} - q AS qc FROM dn)
      SELECT factor, {_ROUND('spread_ir')}, n, {BAR}::DOUBLE AS sr0, {_ROUND('t_adj')}, t_adj >= {_Z!r} AS pass_g3, round((-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa), {D}) AS required FROM ro""",
    "strong_subset": _RECURSIVE(f"{_CELLS}, {_CORR}{_greedy(_NAMED, 'EXISTS (SELECT 1 FROM fc WHERE a = least(p.key, q.key) AND b = greatest(p.key, q.key) AND abs(corr) >= 0.7)')} SELECT n.key AS factor, w.lead = w.i AS kept, CASE WHEN w.lead <> w.i THEN m.key END AS same_as FROM walk w JOIN nodes n ON n.i = w.i JOIN nodes m ON m.i = w.lead"),
    "library_admission": f"""{_CELLS}, {_CORR}, ir AS (SELECT factor, avg(ic) / stddev_samp(ic) AS ir FROM tic GROUP BY 1), nw AS (SELECT * FROM ir WHERE regexp_matches(factor, '^(mom|volz)')), lb AS (SELECT *, factor NOT LIKE '%5' AS active FROM ir WHERE NOT regexp_matches(factor, '^(mom|volz)')),
      nr AS (SELECT nw.factor, lb.factor AS other, lb.ir AS theirs, active, corr FROM nw CROSS JOIN lb JOIN fc ON a = least(nw.factor, lb.factor) AND b = greatest(nw.factor, lb.factor)),
      rw AS (SELECT factor, arg_min(struct_pack(corr := corr, other := other), struct_pack(x := -abs(corr), y := other)) AS v FROM nr GROUP BY 1), lv AS (SELECT factor, arg_min(struct_pack(corr := corr, other := other, theirs := theirs), struct_pack(x := -abs(corr), y := other)) AS v FROM nr WHERE active GROUP BY 1),
      j AS (SELECT nw.factor, nw.ir, rw.v AS r, lv.v AS m, CASE WHEN abs(rw.v.corr) >= 0.99 THEN 'near_copy' WHEN NOT EXISTS (SELECT 1 FROM lb WHERE active) THEN 'first' WHEN lv.v IS NULL OR abs(lv.v.corr) < 0.7 THEN 'independent' WHEN nw.ir > lv.v.theirs THEN 'stronger' ELSE 'weaker' END AS reason FROM nw LEFT JOIN rw USING (factor) LEFT JOIN lv USING (factor))
      SELECT factor, reason IN ('first', 'independent', 'stronger') AS admit, reason, CASE WHEN reason <> 'near_copy' THEN round(m.corr, {D}) END AS corr_max, CASE WHEN reason <> 'near_copy' THEN m.other END AS most_similar, round(r.corr, {D}) AS corr_raw, r.other AS most_similar_raw FROM j""",
}
