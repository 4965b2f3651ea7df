"""What is left of a factor once the factors of a book are taken out, day by day, in the space of ranks.

A day's cross section is one task's work: its columns are ranked, the sums of products are made and solved by Cholesky
there. Book columns that add nothing (copies, sums of others) get a zero pivot and are passed over, which changes no residual.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import Wt, correlation, finite
from ..sources.store import written
from .days import by_day, numbers, pearson, symbols
from .evaluation import MIN_POOL

TOLERANCE = 1e-10


def ordinal_share(x: str, *by: str, least: int = MIN_POOL) -> Column:
    """Ordinal rank over n + 1 among the present values of a group, ties by symbol; null where fewer than ``least`` are present."""
    n = F.count(x).over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last(), "symbol"))
    return F.when(F.col(x).isNotNull() & (n >= least), place / (n + 1.0))


def least_squares(gram: np.ndarray, moments: np.ndarray) -> np.ndarray:
    """Coefficients that solve gram * b = moments by Cholesky; dependent columns get 0."""
    m = len(moments)
    lower, y, x = np.zeros((m, m)), np.zeros(m), np.zeros(m)
    for i in range(m):
        for j in range(i):
            lower[i, j] = (gram[i, j] - lower[i, :j] @ lower[j, :j]) / lower[j, j] if lower[j, j] > 0 else 0.0
        left = gram[i, i] - lower[i, :i] @ lower[i, :i]
        lower[i, i] = np.sqrt(left) if left > TOLERANCE * gram[i, i] else 0.0
    for i in range(m):
        y[i] = (moments[i] - lower[i, :i] @ y[:i]) / lower[i, i] if lower[i, i] > 0 else 0.0
    for i in reversed(range(m)):
        x[i] = (y[i] - lower[i + 1 :, i] @ x[i + 1 :]) / lower[i, i] if lower[i, i] > 0 else 0.0
    return x


def ordinal_shares(v: np.ndarray, least: int) -> np.ndarray:
    """Ordinal ranks over n + 1 of values that lie in order of symbol; NaN for missing ones, all NaN where fewer than ``least`` are present."""
    out = np.full(len(v), np.nan)
    n = int((~np.isnan(v)).sum())
    if n >= least:
        out[np.argsort(v, kind="stable")[:n]] = np.arange(1, n + 1) / (n + 1.0)
    return out


def day_residuals(values: list[np.ndarray], book: list[np.ndarray], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of ``values``: its ordinal ranks on a day, NaN for missing ones, and what the ranks of ``book`` leave of them, NaN outside the fit. All in order of symbol."""
    ranks = [ordinal_shares(v, least) for v in book]
    given = [z for z in ranks if not np.isnan(z).all()]
    whole = np.ones(len(values[0]), bool)
    for z in given:
        whole &= ~np.isnan(z)
    for v in values:
        x = ordinal_shares(v, least)
        own = np.flatnonzero(whole & ~np.isnan(x))
        if not given or len(own) < least:
            yield x, x
            continue
        z = np.stack([k[own] for k in given], 1) - 0.5
        y = x[own] - 0.5
        mz, mx = z.mean(0), y.mean()
        centred = z - mz
        resid = np.full(len(x), np.nan)
        resid[own] = y - mx - centred @ least_squares(centred.T @ centred, centred.T @ (y - mx))
        yield x, resid


def _columns(panel: DataFrame, factors: list[str], book: list[str], *more: Column) -> DataFrame:
    return panel.select("t", "symbol", *more, *[F.col(k).cast("double").alias(f"{p}{i}") for p, ks in (("x", factors), ("z", book)) for i, k in enumerate(ks)])


def _day(table: pa.Table, m: int, n: int, least: int):
    """(rows in order of symbol, residuals of a day's factors)."""
    order = np.argsort(symbols(table)[0])
    held = [[numbers(table, f"{p}{i}")[order] for i in range(k)] for p, k in (("x", m), ("z", n))]
    return order, day_residuals(*held, least)


def orthogonal_residual(panel: DataFrame, factors: list[str], book: list[str], least: int = MIN_POOL) -> DataFrame:
    """Rows (factor, t, symbol, resid) of the columns ``factors``: ordinal ranks less their least-squares fit on the ranks of ``book`` and a constant.

    A day fits on the names present in the factor and in all book columns that have ranks that day. With no such
    column, or with fewer than ``least`` such names, the rank itself stands; names outside the fit have null. Days on
    which a factor has fewer than ``least`` values give no rows. ``book`` is a list of columns, so its square bounds
    the sums of a day; the panel is shuffled once by day, and a task ranks and fits one day.
    """
    names = list(factors)

    def run(table: pa.Table) -> pa.Table:
        order, made = _day(table, len(names), len(book), least)
        text, out = table.column("symbol").combine_chunks(), []
        for factor, (x, resid) in zip(names, made):
            kept = np.flatnonzero(~np.isnan(x))
            r = resid[kept]
            out.append(pa.table({"factor": pa.array([factor]).take(pa.array(np.zeros(len(kept), np.int64))), "t": table.column("t").combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(kept), np.int64))), "symbol": text.take(pa.array(order[kept])), "resid": pa.array(r, mask=np.isnan(r))}))
        return pa.concat_tables(out)

    d = _columns(panel, names, book)
    return by_day(d, run, f"factor string, t {dict(d.dtypes)['t']}, symbol string, resid double")


def plain_mask() -> Column:
    """Bars that moved: high and low present and different."""
    return F.col("h").isNotNull() & F.col("l").isNotNull() & (F.col("h") != F.col("l"))


def summed_forward(panel: DataFrame, horizon: int) -> DataFrame:
    """The panel with ``fwd``: the log returns of the next ``horizon`` rows summed, missing ones as zero, as a simple return; null in the last rows."""
    step = F.coalesce(F.ln(F.when(F.col("c") > 0, F.col("c"))) - F.ln(F.lag(F.when(F.col("c") > 0, F.col("c")), 1).over(Wt())), F.lit(0.0))
    ahead = Wt().rowsBetween(1, horizon)
    d = panel.withColumn("_step", step)
    return d.withColumn("fwd", F.when(F.count(F.lit(1)).over(ahead) == horizon, finite(F.exp(F.sum("_step").over(ahead)) - 1))).drop("_step")


def plain_rank_ic(cells: DataFrame, least: int = MIN_POOL) -> DataFrame:
    """Rows (factor, t, ic) of ``cells(factor, t, symbol, f, fwd)``: correlation of ordinal ranks of days with ``least`` cells."""
    d = cells.where("f is not null and fwd is not null")
    d = d.withColumn("a", ordinal_share("f", "factor", "t", least=least)).withColumn("b", ordinal_share("fwd", "factor", "t", least=least)).where("a is not null")
    return d.groupBy("factor", "t").agg(correlation(F.col("a"), F.col("b")).alias("ic")).where("ic is not null")


def mean_autocorrelation(resid: DataFrame, lag: int = 1) -> DataFrame:
    """Rows (factor, means, autocorr): days that have residuals, and the correlation of their means with those ``lag`` such days later; null where these do not vary."""
    return autocorrelation(resid.groupBy("factor", "t").agg(F.avg("resid").alias("a")), lag)


def autocorrelation(means: DataFrame, lag: int = 1) -> DataFrame:
    """``mean_autocorrelation`` of ``means(factor, t, a)``."""
    means = means.where("a is not null").withColumn("b", F.lead("a", lag).over(Window.partitionBy("factor").orderBy("t")))
    x, y = F.when(F.col("b").isNotNull(), F.col("a")), F.col("b")
    return means.groupBy("factor").agg(F.count("*").alias("means"), F.when(F.stddev_pop(x) * F.stddev_pop(y) >= 1e-12, correlation(x, y)).alias("autocorr"))


def residual_metrics(panel: DataFrame, factors: list[str], book: list[str], horizon: int, least_days: int = 10, least_means: int = 20) -> DataFrame:
    """Rows (factor, resid_ic, days, resid_autocorr, means): mean rank IC of the residuals and the lag-one correlation of their daily means.

    The IC looks at bars that moved, over ``summed_forward``; null under ``least_days`` days. The autocorrelation pairs
    each day that has residuals with the next one that has; null under ``least_means`` days, and where the means are all
    zero, as they are on days with a fit. An empty book has no residuals to speak of: both are null.
    """
    held = list(factors)

    def run(table: pa.Table) -> pa.Table:
        order, made = _day(table, len(held), len(book), MIN_POOL)
        fwd, out = numbers(table, "fwd")[order], []
        for factor, (_, resid) in zip(held, made):
            there = ~np.isnan(resid)
            both, ic = there & ~np.isnan(fwd), None
            if (n := int(both.sum())) >= MIN_POOL:
                a, b = (ordinal_shares(v[both], MIN_POOL) * (n + 1) - (n + 1) / 2 for v in (resid, fwd))
                ic = pearson(a, b)
            out.append((factor, float(resid[there].mean()) if there.any() else None, ic))
        f, a, c = zip(*out)
        t = table.column("t").combine_chunks().slice(0, 1)
        return pa.table({"factor": pa.array(f, pa.string()), "t": t.take(pa.array([0] * len(out))), "a": pa.array(a, pa.float64()), "ic": pa.array(c, pa.float64())})

    ahead = F.when(plain_mask(), F.col("fwd")).cast("double").alias("fwd")
    d = _columns(summed_forward(panel, horizon), held, book, ahead)
    days = written(by_day(d, run, f"factor string, t {dict(d.dtypes)['t']}, a double, ic double"), "residual_days")  # read twice
    signal = days.where("ic is not null").groupBy("factor").agg(F.avg("ic").alias("m"), F.count("*").alias("days"))
    auto = autocorrelation(days)
    names = panel.sparkSession.createDataFrame([(k,) for k in factors], "factor string")
    d = names.join(signal, "factor", "left").join(auto, "factor", "left").na.fill(0, ["days", "means"])
    ok = F.lit(bool(book))
    return d.select("factor", F.when(ok & (F.col("days") >= least_days), F.col("m")).alias("resid_ic"), "days", F.when(ok & (F.col("means") >= least_means), F.col("autocorr")).alias("resid_autocorr"), "means")
