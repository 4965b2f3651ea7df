"""The panel algebra: 34 time-series, 6 cross-sectional and 21 elementwise operators.

Each operator gets a stage function, its input columns and its window or step. ``stage(column)`` adds an
intermediate column and returns a reference, for operators that look at the result of another window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import W, Wt, X, at_least, average_rank, both, clip, correlation, den, gate

Stage = Callable[[Column], Column]


@dataclass(frozen=True)
class Op:
    name: str
    kind: str  # ts, cs or el
    arity: int
    build: Callable
    param: str | None  # window, delay, hump or None
    least: Callable[[int], int] | None = None  # valid rows a window needs


OPS: dict[str, Op] = {}


def op(kind: str, arity: int, param: str | None = None, least: Callable[[int], int] | None = None):
    def add(f):
        OPS[f.__name__] = Op(f.__name__, kind, arity, f, param, least)
        return f

    return add


half = lambda w: max(2, w // 2)
half3 = lambda w: max(3, w // 2)


#: What each operator takes of its windows; over a column of the panel all come from one pass (``rolling``).
TAKES = {
    "ts_mean": ("avg",), "ts_std": ("std",), "ts_sum": ("sum",), "ts_max": ("max",), "ts_min": ("min",), "ts_zscore": ("avg", "std"), "ts_av_diff": ("avg",), "ts_vol_ratio": ("std",), "ts_winsor": ("avg", "std"),
    "ts_drawdown": ("max",), "ts_range_pos": ("min", "max"),
}
PART = {F.avg: "avg", F.stddev_samp: "std", F.sum: "sum", F.min: "min", F.max: "max"}


def rolled(f, stage, x: Column, w: int, least: int) -> Column:
    found = stage.rolling.get((str(x), w, least, PART[f]))
    return gate(f(x).over(W(w)), F.count(x).over(W(w)), least) if found is None else found


def constant(x: Column, w: int) -> Column:
    return F.min(x).over(W(w)) == F.max(x).over(W(w))


# --- time series -------------------------------------------------------------------------------------------------


@op("ts", 1, "window", half)
def ts_mean(stage, x, w):
    return rolled(F.avg, stage, x, w, half(w))


@op("ts", 1, "window", half)
def ts_std(stage, x, w):
    return rolled(F.stddev_samp, stage, x, w, half(w))


@op("ts", 1, "window", half)
def ts_max(stage, x, w):
    return rolled(F.max, stage, x, w, half(w))


@op("ts", 1, "window", half)
def ts_min(stage, x, w):
    return rolled(F.min, stage, x, w, half(w))


@op("ts", 1, "window", half)
def ts_sum(stage, x, w):
    return rolled(F.sum, stage, x, w, half(w))


@op("ts", 1, "window", half)
def ts_rank(stage, x, w, least=None):
    seen = stage(F.collect_list(x).over(W(w)))
    below = F.size(F.filter(seen, lambda v: v < x))
    ties = F.size(F.filter(seen, lambda v: v == x))
    return F.when(x.isNotNull() & (F.size(seen) >= (least or half(w))), (below + (ties + 1) / 2.0) / F.size(seen))


@op("ts", 1, "window", half)
def ts_zscore(stage, x, w):
    return (x - ts_mean(stage, x, w)) / at_least(ts_std(stage, x, w), 1e-12)


@op("ts", 1, "window", lambda w: max(3, w))
def ts_skew(stage, x, w):
    n = F.count(x).over(W(w)).cast("double")
    return gate(F.when(constant(x, w), 0.0).otherwise(F.skewness(x).over(W(w)) * F.sqrt(n * (n - 1)) / (n - 2)), n, max(3, w))


@op("ts", 1, "window", lambda w: max(4, w))
def ts_kurt(stage, x, w):
    n = F.count(x).over(W(w)).cast("double")
    return gate(F.when(constant(x, w), -3.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(W(w)) + 6)), n, max(4, w))


@op("ts", 2, "window", half3)
def ts_corr(stage, x, y, w, least=None):
    return gate(correlation(x, y, W(w)), F.count(both(x, y)).over(W(w)), least or half3(w))


@op("ts", 2, "window", half3)
def ts_cov(stage, x, y, w):
    return gate(F.covar_samp(both(x, y), both(y, x)).over(W(w)), F.count(both(x, y)).over(W(w)), half3(w))


@op("ts", 1, "window", half)
def ts_slope(stage, x, w):
    t = F.col("t").cast("double")
    top = F.avg(x * t).over(W(w)) - F.avg(x).over(W(w)) * F.avg(t).over(W(w))
    return gate(top / at_least(F.var_samp(x).over(W(w)), 1e-12), F.count(x).over(W(w)), half(w))


@op("ts", 1, "delay")
def ts_delay(stage, x, d):
    return F.lag(x, d).over(Wt())


@op("ts", 1, "delay")
def ts_diff(stage, x, d):
    return x - F.lag(x, d).over(Wt())


def decayed(stage, x, weights: list[float], least: int) -> Column:
    """Weighted mean, newest first; early rows use the weights they have, and a NULL inside the window gives NULL."""
    w = len(weights)
    held = stage(F.collect_list(F.struct(x.alias("v"))).over(W(w)))
    n = F.size(held)
    value = F.aggregate(F.zip_with(F.reverse(held), F.slice(F.array(*map(F.lit, weights)), 1, n), lambda h, k: h["v"] * k), F.lit(0.0), lambda a, b: a + b)
    total = F.aggregate(F.slice(F.array(*map(F.lit, weights)), 1, n), F.lit(0.0), lambda a, b: a + b)
    return gate(value / total, n, least)


@op("ts", 1, "window", half)
def ts_decay_linear(stage, x, w):
    return decayed(stage, x, [float(w - k) for k in range(w)], half(w))


@op("ts", 1, "window", half)
def ts_av_diff(stage, x, w):
    return x - ts_mean(stage, x, w)


@op("ts", 1, "window")
def ts_momentum(stage, x, w):
    return x / den(F.lag(x, w).over(Wt())) - 1


@op("ts", 2, "window", half)
def ts_vol_ratio(stage, x, y, w):
    return ts_std(stage, x, w) / at_least(ts_std(stage, y, w), 1e-12)


@op("ts", 2, "window", half3)
def ts_beta(stage, y, x, w):
    """Slope of y on x; the covariance over rows with both, the variance over all rows with x."""
    cov = gate(F.covar_samp(both(x, y), both(y, x)).over(W(w)), F.count(both(x, y)).over(W(w)), half3(w))
    var = gate(F.var_samp(x).over(W(w)), F.count(x).over(W(w)), half3(w))
    return cov / at_least(var, 1e-12)


@op("ts", 2, "window", half3)
def ts_resid(stage, y, x, w):
    return y - ts_beta(stage, y, x, w) * x


@op("ts", 1, "window", half)
def ts_decay_exp(stage, x, w):
    return decayed(stage, x, [0.5**k for k in range(w)], half(w))


@op("ts", 1, "hump")
def hump(stage, x, h):
    before = F.lag(x, 1).over(Wt())
    return F.when(F.abs(x - before) / at_least(F.abs(before), 1e-12) >= h, x).otherwise(before)


@op("ts", 2, "window", half)
def ts_wmean(stage, x, y, w):
    return rolled(F.sum, stage, x * y, w, half(w)) / den(rolled(F.sum, stage, y, w, half(w)))


@op("ts", 1, "window", half)
def ts_drawdown(stage, x, w):
    return x / den(ts_max(stage, x, w)) - 1


@op("ts", 1, "window", half)
def ts_range_pos(stage, x, w):
    hi, lo = ts_max(stage, x, w), ts_min(stage, x, w)
    return (x - lo) / at_least(F.abs(hi - lo), 1e-12)


def extreme(x, w: int, sign: float) -> Column:
    """Rows since the oldest extreme in the window, or since the oldest missing row where there is one."""
    t = F.col("t")
    best = F.min_by(t, F.struct(sign * x, t)).over(W(w))
    hole = F.min(F.when(x.isNull(), t)).over(W(w))
    return gate((t - F.coalesce(hole, best)).cast("double"), F.count(x).over(W(w)), half(w))


@op("ts", 1, "window", half)
def ts_arg_max(stage, x, w):
    return extreme(x, w, -1.0)


@op("ts", 1, "window", half)
def ts_arg_min(stage, x, w):
    return extreme(x, w, 1.0)


@op("ts", 1, "window", half3)
def ts_median(stage, x, w):
    return gate(F.percentile(x, 0.5).over(W(w)), F.count(x).over(W(w)), half3(w))


@op("ts", 1, "window", half3)
def ts_iqr(stage, x, w):
    return gate(F.percentile(x, 0.75).over(W(w)) - F.percentile(x, 0.25).over(W(w)), F.count(x).over(W(w)), half3(w))


@op("ts", 1, "window", half3)
def ts_winsor(stage, x, w):
    m, s = rolled(F.avg, stage, x, w, half3(w)), rolled(F.stddev_samp, stage, x, w, half3(w))
    return clip(x, m - 3 * s, m + 3 * s)


@op("ts", 2, "window", lambda w: max(3, w))
def ts_rank_corr(stage, x, y, w):
    return ts_corr(stage, stage(ts_rank(stage, x, w, half3(w))), stage(ts_rank(stage, y, w, half3(w))), w, max(3, w))


@op("ts", 1, "window")
def ts_streak(stage, x, w):
    s = stage(F.signum(x - F.lag(x, 1).over(Wt())))
    before = F.lag(s, 1).over(Wt())
    run = stage(F.sum(F.when((s == before) & s.isNotNull() & before.isNotNull(), 0).otherwise(1)).over(Wt()))
    length = F.row_number().over(Window.partitionBy("symbol", run).orderBy("t"))
    return clip(s * length, -float(w), float(w))


def mean_of(w: int, *factors: Column) -> Column:
    """Rolling mean of a product over the rows where its own factors are present."""
    product = factors[0]
    for f in factors[1:]:
        product = product * f
    return F.avg(product).over(W(w))


@op("ts", 2, "window", lambda w: max(4, w // 2))
def ts_coskew(stage, x, y, w):
    m = lambda *c: mean_of(w, *c)
    top = m(x, x, y) - 2 * m(x) * m(x, y) - m(y) * m(x, x) + 2 * m(x) * m(x) * m(y)
    sx, sy = (F.stddev_samp(u).over(W(w)) for u in (x, y))
    return gate(top / at_least(sx * sx * sy, 1e-18), F.count(x * y).over(W(w)), max(4, w // 2))


@op("ts", 3, "window", lambda w: max(4, w // 2))
def ts_triple_corr(stage, x, y, z, w):
    m = lambda *c: mean_of(w, *c)
    top = m(x, y, z) - m(x) * m(y, z) - m(y) * m(x, z) - m(z) * m(x, y) + 2 * m(x) * m(y) * m(z)
    sx, sy, sz = (F.stddev_samp(u).over(W(w)) for u in (x, y, z))
    return gate(top / den(sx * sy * sz, 1e-18), F.count(x * y * z).over(W(w)), max(4, w // 2))


# --- cross sections ----------------------------------------------------------------------------------------------


@op("cs", 1)
def cs_rank(stage, x):
    return average_rank(x, "t") / F.count(x).over(X())


@op("cs", 1)
def cs_zscore(stage, x):
    return (x - F.avg(x).over(X())) / at_least(F.stddev_samp(x).over(X()), 1e-12)


@op("cs", 1)
def cs_winsorize(stage, x, k=3.0):
    m, s = F.avg(x).over(X()), at_least(F.stddev_samp(x).over(X()), 1e-12)
    return clip(x, m - k * s, m + k * s)


@op("cs", 1)
def cs_scale(stage, x):
    return x / at_least(F.sum(F.abs(x)).over(X()), 1e-12)


@op("cs", 1)
def cs_demean(stage, x):
    return x - F.avg(x).over(X())


@op("cs", 1)
def cs_robust_z(stage, x):
    q = stage(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(X()))
    return (x - q[1]) / at_least(q[2] - q[0], 1e-12)


# --- elementwise -------------------------------------------------------------------------------------------------


@op("el", 2)
def add(stage, x, y):
    return x + y


@op("el", 2)
def sub(stage, x, y):
    return x - y


@op("el", 2)
def mul(stage, x, y):
    return x * y


@op("el", 2)
def div(stage, x, y):
    return x / den(y)


@op("el", 2)
def minv(stage, x, y):
    return F.least(both(x, y), both(y, x))


@op("el", 2)
def maxv(stage, x, y):
    return F.greatest(both(x, y), both(y, x))


@op("el", 2)
def signed_diff(stage, x, y):
    return F.signum(x - y)


@op("el", 2)
def sfdiff(stage, x, y):
    return (x - y) / at_least(F.abs(x) + F.abs(y), 1e-12)


@op("el", 1)
def absx(stage, x):
    return F.abs(x)


@op("el", 1)
def signx(stage, x):
    return F.signum(x)


@op("el", 1)
def negx(stage, x):
    return -x


@op("el", 1)
def log1p_abs(stage, x):
    return F.log1p(F.abs(x))


@op("el", 1)
def sigmoid(stage, x):
    return 1 / (1 + F.exp(-clip(x, -30, 30)))


@op("el", 1)
def tanhx(stage, x):
    return F.tanh(clip(x, -30, 30))


@op("el", 1)
def sqrt_abs(stage, x):
    return F.sqrt(F.abs(x))


@op("el", 1)
def inv(stage, x):
    return 1 / den(x)


@op("el", 1)
def log_signed(stage, x):
    return F.signum(x) * F.log1p(F.abs(x))


@op("el", 1)
def softsign(stage, x):
    return x / (1 + F.abs(x))


@op("el", 2)
def gt(stage, x, y):
    return F.when(x > y, 1.0).otherwise(0.0)


@op("el", 2)
def lt(stage, x, y):
    return F.when(x < y, 1.0).otherwise(0.0)


@op("el", 3)
def where(stage, c, a, b):
    """Arithmetic blend: a missing value in either branch gives a missing one."""
    return c * a + (1 - c) * b
