"""A query and its DuckDB SQL for each operator of the panel algebra, over the weekly panel by supplier.

Inputs are x = ln close, y = ln(1 + volume), z = ln open; results are rounded, as sums run in other orders elsewhere.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.panel_ops import OPS
from ..sources.market import PANEL_SQL, panel
from .expr import Node, evaluate, leaf

PARAMS = {"window": 10, "delay": 3, "hump": 0.05}
DIGITS = 6


def input_panel(spark, sf_dir):
    return panel(spark, sf_dir).select("symbol", "t", F.log("c").alias("x"), F.log1p("v").alias("y"), F.log("o").alias("z"))


def node_of(name: str) -> Node:
    o = OPS[name]
    args = [leaf(c) for c in "xyz"[: o.arity]]
    if name == "where":
        args = [Node("gt", (leaf("x"), leaf("z"))), leaf("x"), leaf("y")]
    return Node(name, tuple(args), PARAMS[o.param] if o.param else None)


def query(name: str):
    def run(spark, sf_dir):
        df = evaluate(input_panel(spark, sf_dir), {"f": node_of(name)})
        return df.select("symbol", "t", F.round("f", DIGITS).alias("f"))

    run.__name__ = f"alg_{name}"
    return run


def _roll(f: str, arg: str = "x") -> str:
    return f"{f}({arg}) OVER w"


def _g(value: str, least: int, count: str = "x") -> str:
    return f"CASE WHEN count({count}) OVER w >= {least} THEN {value} END"


def _floor(v: str, m: str) -> str:
    return f"(CASE WHEN ({v}) < {m} THEN {m} ELSE ({v}) END)"


def _den(v: str, least: str = "1e-9") -> str:
    return f"({_floor(f'abs({v})', least)} * CASE WHEN ({v}) = 0 THEN 1.0 ELSE sign({v}) END)"


def _clip(v: str, lo: str, hi: str) -> str:
    return f"CASE WHEN ({v}) IS NULL OR ({lo}) IS NULL OR ({hi}) IS NULL THEN NULL WHEN ({v}) < ({lo}) THEN ({lo}) WHEN ({v}) > ({hi}) THEN ({hi}) ELSE ({v}) END"


_XY = "CASE WHEN y IS NOT NULL THEN x END"
_YX = "CASE WHEN x IS NOT NULL THEN y END"
_PAIR = "x + y"
_ALL = "x + y + z"
_mean, _std = _g(_roll("avg"), 5), _g(_roll("stddev_samp"), 5)
_max, _min = _g(_roll("max"), 5), _g(_roll("min"), 5)
_cov = f"covar_samp({_XY}, {_YX}) OVER w"
_corr = f"(CASE WHEN (stddev_samp({_XY}) OVER w) * (stddev_samp({_YX}) OVER w) <> 0 THEN ({_cov}) / ((stddev_samp({_XY}) OVER w) * (stddev_samp({_YX}) OVER w)) END)"
# Beta of x (as the first input) on y.
_beta = f"(({_g(_cov, 5, _PAIR)}) / {_floor(_g('var_samp(y) OVER w', 5, 'y'), '1e-12')})"


def _decay(weights: list[float]) -> str:
    # A lag beyond the first row has no weight; one whose value is missing makes the result missing.
    top = " + ".join(f"CASE WHEN t >= {k} THEN {w!r} * lag(x, {k}) OVER s ELSE 0 END" for k, w in enumerate(weights))
    low = " + ".join(f"CASE WHEN t >= {k} THEN {w!r} ELSE 0 END" for k, w in enumerate(weights))
    return _g(f"({top}) / ({low})", 5)


def _rank(x: str) -> str:
    held = f"(list({x}) FILTER ({x} IS NOT NULL) OVER w)"
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER w >= 5 THEN (len(list_filter({held}, lambda v: v < {x})) + (len(list_filter({held}, lambda v: v = {x})) + 1) / 2.0) / len({held}) END"


def _m(*cols: str) -> str:
    return f"(avg({' * '.join(cols)}) OVER w)"


_s = {c: f"(stddev_samp({c}) OVER w)" for c in "xyz"}
_coskew = f"({_m('x', 'x', 'y')} - 2 * {_m('x')} * {_m('x', 'y')} - {_m('y')} * {_m('x', 'x')} + 2 * {_m('x')} * {_m('x')} * {_m('y')}) / {_floor(f'{_s[chr(120)]} * {_s[chr(120)]} * {_s[chr(121)]}', '1e-18')}"
_triple = (
    f"({_m('x', 'y', 'z')} - {_m('x')} * {_m('y', 'z')} - {_m('y')} * {_m('x', 'z')} - {_m('z')} * {_m('x', 'y')} + 2 * {_m('x')} * {_m('y')} * {_m('z')})"
    f" / {_den(' * '.join(_s.values()), '1e-18')}"
)


def _arg(f: str) -> str:
    return _g(f"CAST(t - coalesce(min(CASE WHEN x IS NULL THEN t END) OVER w, arg_min(t, row({f}, t)) OVER w) AS DOUBLE)", 5)


_cs_rank = "CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY t ORDER BY x NULLS LAST) + (count(x) OVER (PARTITION BY t, x) - 1) / 2.0) / count(x) OVER k END"
_clipped = _clip("x", "-30", "30")

SQL = {
    "ts_mean": _mean, "ts_std": _std, "ts_max": _max, "ts_min": _min, "ts_sum": _g(_roll("sum"), 5), "ts_rank": _rank("x"),
    "ts_zscore": f"(x - ({_mean})) / {_floor(_std, '1e-12')}", "ts_skew": _g(f"CASE WHEN {_roll('min')} = {_roll('max')} THEN 0.0 ELSE {_roll('skewness')} END", 10), "ts_kurt": _g(f"CASE WHEN {_roll('min')} = {_roll('max')} THEN -3.0 ELSE {_roll('kurtosis')} END", 10),
    "ts_corr": _g(_corr, 5, _PAIR), "ts_cov": _g(_cov, 5, _PAIR),
    "ts_slope": _g(f"(avg(x * t) OVER w - (avg(x) OVER w) * (avg(t) OVER w)) / {_floor(_roll('var_samp'), '1e-12')}", 5),
    "ts_delay": "lag(x, 3) OVER s", "ts_diff": "x - lag(x, 3) OVER s", "ts_decay_linear": _decay([10.0 - k for k in range(10)]),
    "ts_av_diff": f"x - ({_mean})", "ts_momentum": f"x / {_den('lag(x, 10) OVER s')} - 1",
    "ts_vol_ratio": f"({_std}) / {_floor(_g('stddev_samp(y) OVER w', 5, 'y'), '1e-12')}", "ts_resid": f"x - {_beta} * y", "ts_beta": _beta,
    "ts_decay_exp": _decay([0.5**k for k in range(10)]),
    "hump": f"CASE WHEN abs(x - lag(x, 1) OVER s) / {_floor('abs(lag(x, 1) OVER s)', '1e-12')} >= 0.05 THEN x ELSE lag(x, 1) OVER s END",
    "ts_wmean": f"({_g('sum(x * y) OVER w', 5, _PAIR)}) / {_den(_g('sum(y) OVER w', 5, 'y'))}",
    "ts_drawdown": f"x / {_den(_max)} - 1", "ts_range_pos": f"(x - ({_min})) / {_floor(f'abs(({_max}) - ({_min}))', '1e-12')}",
    "ts_arg_max": _arg("-x"), "ts_arg_min": _arg("x"), "ts_median": _g("quantile_cont(x, 0.5::DOUBLE) OVER w", 5),
    "ts_iqr": _g("quantile_cont(x, 0.75::DOUBLE) OVER w - quantile_cont(x, 0.25::DOUBLE) OVER w", 5),
    "ts_winsor": _clip("x", f"({_mean}) - 3 * ({_std})", f"({_mean}) + 3 * ({_std})"),
    "ts_coskew": _g(_coskew, 5, _PAIR), "ts_triple_corr": _g(_triple, 5, _ALL),
    "cs_rank": _cs_rank, "cs_zscore": f"(x - avg(x) OVER k) / {_floor('stddev_samp(x) OVER k', '1e-12')}",
    "cs_winsorize": _clip("x", f"avg(x) OVER k - 3 * {_floor('stddev_samp(x) OVER k', '1e-12')}", f"avg(x) OVER k + 3 * {_floor('stddev_samp(x) OVER k', '1e-12')}"),
    "cs_scale": f"x / {_floor('sum(abs(x)) OVER k', '1e-12')}", "cs_demean": "x - avg(x) OVER k",
    "cs_robust_z": f"(x - quantile_cont(x, 0.5::DOUBLE) OVER k) / {_floor('quantile_cont(x, 0.75::DOUBLE) OVER k - quantile_cont(x, 0.25::DOUBLE) OVER k', '1e-12')}",
    "add": "x + y", "sub": "x - y", "mul": "x * y", "div": f"x / {_den('y')}",
    "minv": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN least(x, y) END", "maxv": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(x, y) END",
    "signed_diff": "CAST(sign(x - y) AS DOUBLE)", "sfdiff": f"(x - y) / {_floor('abs(x) + abs(y)', '1e-12')}", "absx": "abs(x)", "signx": "CAST(sign(x) AS DOUBLE)", "negx": "-x",
    "log1p_abs": "ln(1 + abs(x))", "sigmoid": f"1 / (1 + exp(-({_clipped})))", "tanhx": f"tanh({_clipped})", "sqrt_abs": "sqrt(abs(x))", "inv": f"1 / {_den('x')}",
    "log_signed": "sign(x) * ln(1 + abs(x))", "softsign": "x / (1 + abs(x))",
    "gt": "CASE WHEN x > y THEN 1.0 ELSE 0.0 END::DOUBLE", "lt": "CASE WHEN x < y THEN 1.0 ELSE 0.0 END::DOUBLE",
    "where": "(CASE WHEN x > z THEN 1.0 ELSE 0.0 END) * x + (1 - (CASE WHEN x > z THEN 1.0 ELSE 0.0 END)) * y",
}

_WINDOWS = "WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), s AS (PARTITION BY symbol ORDER BY t), k AS (PARTITION BY t)"
_HEAD = f"WITH {PANEL_SQL}, p AS (SELECT symbol, t, ln(c) AS x, ln(1 + v) AS y, ln(o) AS z FROM panel)"


def oracle(name: str) -> str:
    if name == "ts_rank_corr":
        r = f"r AS (SELECT symbol, t, {_rank('x')} AS x, {_rank('y')} AS y FROM p {_WINDOWS})"
        return f"{_HEAD}, {r} SELECT symbol, t, round({_g(_corr, 10, _PAIR)}, {DIGITS}) AS f FROM r {_WINDOWS}"
    if name == "ts_streak":
        a = "a AS (SELECT symbol, t, CAST(sign(x - lag(x, 1) OVER s) AS DOUBLE) AS g FROM p WINDOW s AS (PARTITION BY symbol ORDER BY t))"
        b = "b AS (SELECT *, sum(CASE WHEN g = h THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY t) AS run FROM (SELECT *, lag(g, 1) OVER (PARTITION BY symbol ORDER BY t) AS h FROM a))"
        c = "c2 AS (SELECT symbol, t, g * row_number() OVER (PARTITION BY symbol, run ORDER BY t) AS v FROM b)"
        return f"{_HEAD}, {a}, {b}, {c} SELECT symbol, t, CASE WHEN v < -10 THEN -10.0::DOUBLE WHEN v > 10 THEN 10.0::DOUBLE ELSE v END AS f FROM c2"
    return f"{_HEAD} SELECT symbol, t, round({SQL[name]}, {DIGITS}) AS f FROM p {_WINDOWS}"


QUERIES = {f"alg_{n}": query(n) for n in OPS}
ORACLES = {f"alg_{n}": oracle(n) for n in OPS}
