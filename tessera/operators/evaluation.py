"""Forward returns, rank IC, IC diagnostics, top-k portfolios and factor correlations.

A panel with factor columns becomes one long table (factor, t, symbol, f, fwd); everything after is grouped by factor
and t, so many factors and horizons share one job. Rows that are not sampled are dropped before the shuffle on t.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import Wt, average_rank, correlation, finite, normal
from .days import by_day, centred_ranks, numbers, pearson

MIN_POOL = 30


def forward_return(horizon: int, execution: str = "t1") -> Column:
    """From the next open (t1) or this close (t0) to the close ``horizon`` rows ahead."""
    start = F.lead("o", 1).over(Wt()) if execution == "t1" else F.col("c")
    return finite(F.try_divide(F.lead("c", horizon).over(Wt()), start) - 1)


def region(dev_end, sel_end) -> Column:
    return F.when(F.col("date") < F.lit(dev_end), "train").when(F.col("date") < F.lit(sel_end), "selection").otherwise("test")


def cells(panel: DataFrame, factors: list[str], horizon: int, step: int, ok: Column, execution: str = "t1") -> DataFrame:
    """Sampled valid cells (factor, t, date, symbol, f, fwd): tradable, factor and return present, t a multiple of step."""
    return sampled_cells(panel.withColumn("fwd", forward_return(horizon, execution)), factors, step, ok)


def sampled_cells(valued: DataFrame, factors: list[str], step: int, ok: Column) -> DataFrame:
    """``cells`` of a panel that has its ``fwd`` already."""
    df = valued.withColumn("ok", ok).where((F.col("t") % step == 0) & F.col("ok") & F.col("fwd").isNotNull())
    pairs = F.array(*[F.struct(F.lit(k).alias("factor"), F.col(k).alias("f")) for k in factors])
    return df.select("t", "date", "symbol", "fwd", F.explode(pairs).alias("p")).select("p.factor", "t", "date", "symbol", "p.f", "fwd").where("f is not null")


def pooled(valid: DataFrame, least: int = MIN_POOL) -> DataFrame:
    return valid.withColumn("n", F.count("*").over(Window.partitionBy("factor", "t"))).where(F.col("n") >= least)


def rank_ic(valid: DataFrame, least: int = MIN_POOL) -> DataFrame:
    """Rows (factor, t, date, ic): correlation of ranks among a day's valid cells; days without variance are left out."""
    ranked = pooled(valid, least).withColumn("rf", average_rank(F.col("f"), "factor", "t") / F.col("n")).withColumn("rr", average_rank(F.col("fwd"), "factor", "t") / F.col("n"))
    return ranked.groupBy("factor", "t", "date").agg(correlation(F.col("rf"), F.col("rr")).alias("ic")).where("ic is not null")


def sampled_days(panel: DataFrame, factors: list[str], step: int, ok: Column, *more: str) -> DataFrame:
    """What ``cells`` keeps of a panel that has its ``fwd``, one row for all factors of a name: t, ``more``, fwd, and the factors as f0, f1, ..."""
    kept = panel.where((F.col("t") % step == 0) & ok & F.col("fwd").isNotNull())
    return kept.select("t", *more, F.col("fwd").cast("double").alias("fwd"), *[F.col(k).cast("double").alias(f"f{i}") for i, k in enumerate(factors)])


def day_ic(panel: DataFrame, factors: list[str], horizon: int, step: int, ok: Column, execution: str = "t1", least: int = MIN_POOL) -> DataFrame:
    """``rank_ic`` of the panel's ``cells``: a day's names with all their factors are ranked inside one task."""
    return valued_ic(panel.withColumn("fwd", forward_return(horizon, execution)), factors, step, ok, least)


def valued_ic(valued: DataFrame, factors: list[str], step: int, ok: Column, least: int = MIN_POOL) -> DataFrame:
    """``day_ic`` of a panel that has its ``fwd`` already."""
    names = list(factors)

    def run(table: pa.Table) -> pa.Table:
        fwd, out = numbers(table, "fwd"), []
        mask, right = None, None
        for i, factor in enumerate(names):
            f = numbers(table, f"f{i}")
            there = ~np.isnan(f)
            if there.sum() < least:
                continue
            if mask is None or (there != mask).any():
                mask, right = there, centred_ranks(fwd[there])
            if (ic := pearson(centred_ranks(f[there]), right)) is not None:
                out.append((factor, ic))
        t, date = table.column("t")[0], table.column("date")[0]
        found, ics = zip(*out) if out else ((), ())
        return pa.table({"factor": pa.array(found, pa.string()), "t": pa.array([t.as_py()] * len(out), t.type), "date": pa.array([date.as_py()] * len(out), date.type), "ic": pa.array(ics, pa.float64())})

    d = sampled_days(valued, names, step, ok, "date")
    return by_day(d, run, f"factor string, t {dict(d.dtypes)['t']}, date {dict(d.dtypes)['date']}, ic double")


def ic_stats(ic: DataFrame, *by: str) -> DataFrame:
    m, s = F.avg("ic"), F.stddev_samp("ic")
    return ic.groupBy("factor", *by).agg(m.alias("mean"), s.alias("std"), F.try_divide(m, s).alias("ir"), F.count("*").alias("n"))


def yearly_consistency(ic: DataFrame) -> DataFrame:
    """Share of years whose mean IC has the sign of the whole; one half where the whole has none."""
    years = ic.groupBy("factor", F.year("date").alias("year")).agg(F.avg("ic").alias("m"))
    whole = ic.groupBy("factor").agg(F.signum(F.avg("ic")).alias("s"))
    share = F.avg((F.signum("m") == F.col("s")).cast("double"))
    return years.join(F.broadcast(whole), "factor").groupBy("factor", "s").agg(share.alias("share"), F.count("*").alias("years")).select("factor", F.when(F.col("s") == 0, 0.5).otherwise(F.col("share")).alias("share"), "years")


def rolling_stability(ic: DataFrame, window: int = 252) -> DataFrame:
    """Share of full rolling means of ``window`` observations that have the sign of the whole."""
    w = Window.partitionBy("factor").orderBy("t").rowsBetween(-(window - 1), 0)
    r = ic.withColumn("m", F.avg("ic").over(w)).withColumn("k", F.count("*").over(w)).withColumn("s", F.signum(F.avg("ic").over(Window.partitionBy("factor"))))
    return r.where(F.col("k") == window).groupBy("factor").agg(F.avg((F.signum("m") == F.col("s")).cast("double")).alias("share"), F.count("*").alias("windows"))


def segments(ic: DataFrame, k: int | None = None) -> DataFrame:
    """Contiguous buckets of an IC series, ``k`` or clip(n // 20, 2, 8), with edges at i * n div k."""
    order = Window.partitionBy("factor").orderBy("t")
    n = F.count("*").over(Window.partitionBy("factor"))
    d = ic.withColumn("i", F.row_number().over(order) - 1).withColumn("n", n)
    parts = F.lit(k) if k else F.greatest(F.lit(2), F.least(F.lit(8), F.floor(F.col("n") / 20)))
    # The bucket b with b * n div k <= i < (b + 1) * n div k.
    return d.withColumn("k", parts.cast("int")).withColumn("bucket", F.expr("cast(((i + 1) * k - 1) div n as int)"))


def decay(ic: DataFrame) -> DataFrame:
    """By factor: bucket means in order, their slope, first to last change in standard errors, whether the sign flips."""
    b = segments(ic).groupBy("factor", "k", "bucket").agg(F.avg("ic").alias("m"), F.count("*").alias("c"), F.max("n").alias("n"))
    whole = ic.groupBy("factor").agg(F.stddev_samp("ic").alias("std"))
    got = b.groupBy("factor", "k").agg(
        F.when(F.count("*") >= 3, F.regr_slope("m", F.col("bucket").cast("double"))).alias("slope"), F.min_by("m", "bucket").alias("first"), F.max_by("m", "bucket").alias("last"), F.max("n").alias("n")
    )
    se = F.sqrt(F.lit(2.0)) * F.col("std") / F.sqrt(F.floor(F.col("n") / F.col("k")))
    return got.join(F.broadcast(whole), "factor").select("factor", "k", "slope", "first", "last", F.try_divide(F.col("last") - F.col("first"), se).alias("z"), (F.signum("first") * F.signum("last") < 0).alias("flips"))


def walk_forward(ic: DataFrame, folds: int) -> DataFrame:
    return ic_stats(segments(ic, folds).withColumnRenamed("bucket", "fold"), "fold")


def drawdown_ratio(ic: DataFrame) -> DataFrame:
    """Largest fall of the summed IC, turned to the sign of its mean, over its end value; null under 5 rows or for an end of nearly zero."""
    whole, upto = Window.partitionBy("factor"), Window.partitionBy("factor").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    turned = ic.withColumn("a", F.when(F.avg("ic").over(whole) >= 0, F.col("ic")).otherwise(-F.col("ic")))
    summed = turned.withColumn("c", F.sum("a").over(upto))
    fallen = summed.withColumn("fall", F.max("c").over(upto) - F.col("c")).groupBy("factor").agg(F.max("fall").alias("fall"), F.abs(F.sum("a")).alias("end"), F.count("*").alias("n"))
    return fallen.select("factor", F.when((F.col("n") >= 5) & (F.col("end") > 1e-9), F.try_divide("fall", "end")).alias("ratio"), "n")


def shift_placebo(panel: DataFrame, factors: list[str], horizon: int, step: int, ok: Column, shifts: tuple[int, ...] = (0, 5, 10, 21)) -> DataFrame:
    """Mean rank IC of each factor as it was ``shift`` rows before; rows (factor, shift, mean, n), null under 2 days. All shifts share one pass."""
    late = panel.withColumns({f"{f}@{k}": F.lag(f, k).over(Wt()) for f in factors for k in shifts})
    ic = day_ic(late, [f"{f}@{k}" for f in factors for k in shifts], horizon, step, ok)
    name, shift = F.substring_index("factor", "@", 1).alias("factor"), F.substring_index("factor", "@", -1).cast("int").alias("shift")
    return ic.groupBy(name, shift).agg(F.when(F.count("*") >= 2, F.avg("ic")).alias("mean"), F.count("*").alias("n"))


def top_k(valid: DataFrame, k_frac: float = 0.2, least: int = 8, cost_bps: float = 10.0) -> DataFrame:
    """Rows (factor, t, date, k, gross, turn, net): mean return of the best k over the pool, turnover against the last traded day, cost on both sides."""
    d = pooled(valid, least).withColumn("k", F.greatest(F.lit(1), F.bround(F.col("n") * k_frac).cast("int")))
    d = d.withColumn("rn", F.row_number().over(Window.partitionBy("factor", "t").orderBy(F.desc("f"), "symbol")))
    top = F.col("rn") <= F.col("k")
    day = d.groupBy("factor", "t", "date", "k").agg((F.avg(F.when(top, F.col("fwd"))) - F.avg("fwd")).alias("gross"), F.array_sort(F.collect_list(F.when(top, F.col("symbol")))).alias("held"))
    before = F.lag("held", 1).over(Window.partitionBy("factor").orderBy("t"))
    day = day.withColumn("prev", before)
    moved = F.size(F.array_except("held", "prev")) + F.size(F.array_except("prev", "held"))
    day = day.withColumn("turn", F.when(F.col("prev").isNull(), 1.0).otherwise(moved / (2.0 * F.col("k"))))
    return day.select("factor", "t", "date", "k", "gross", "turn", (F.col("gross") - 2 * F.col("turn") * cost_bps / 1e4).alias("net"))


def top_k_summary(days: DataFrame, per_year: float) -> DataFrame:
    g, n = F.avg("gross"), F.avg("net")
    return days.groupBy("factor").agg(
        F.try_divide(g, F.stddev_samp("gross")).alias("spread_ir"), F.try_divide(n, F.stddev_samp("net")).alias("net_ir"), (g * per_year * 100).alias("gross_annual"), (n * per_year * 100).alias("net_annual"),
        F.avg("turn").alias("turn"), F.try_divide(g * 1e4, 2 * F.avg("turn")).alias("break_even_bps"), F.count("*").alias("n"),
    )


def rank_autocorrelation(panel: DataFrame, factors: list[str], lag: int, step: int, ok: Column, least: int = 8, least_days: int = 5) -> DataFrame:
    """Rows (factor, autocorr, days): mean correlation of ordinal ranks between sampled days and ``lag`` rows later, among the names tradable and valued on both.

    Returns play no part. Ties go by symbol; a day needs ``least`` names, and autocorr is null under ``least_days`` days.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("factor"), F.col(k).alias("f")) for k in factors]))
    d = panel.where(ok).select("t", "symbol", pairs.alias("p")).select("p.factor", "t", "symbol", "p.f").where("f is not null")
    later = d.select("factor", (F.col("t") - lag).alias("t"), "symbol", F.col("f").alias("g"))
    both = d.where(F.col("t") % step == 0).join(later, ["factor", "t", "symbol"])
    place = lambda c: F.row_number().over(Window.partitionBy("factor", "t").orderBy(c, "symbol")).cast("double")
    day = both.withColumn("a", place("f")).withColumn("b", place("g")).groupBy("factor", "t").agg(correlation(F.col("a"), F.col("b")).alias("x"), F.count("*").alias("n"))
    return day.where((F.col("n") >= least) & F.col("x").isNotNull()).groupBy("factor").agg(F.when(F.count("*") >= least_days, F.avg("x")).alias("autocorr"), F.count("*").alias("days"))


def factor_correlations(panel: DataFrame, factors: list[str], step: int, least: int = MIN_POOL, block: int = 128) -> DataFrame:
    """Rows (a, b, corr, days): mean daily correlation of ranks, each factor ranked on its own valid cells, for a < b.

    A task holds a day's cross section of two blocks of factors as a matrix, ranks its columns and gives their
    correlations from products of matrices; days are averaged by pair, combined before the shuffle. A day counts for a
    pair with ``least`` names valid in both.
    """
    names = sorted(factors)
    groups = [names[k : k + block] for k in range(0, len(names), block)]
    both = [(p, q, groups[p] + (groups[q] if q > p else [])) for p in range(len(groups)) for q in range(p, len(groups))]
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.array(*[F.col(k).cast("double") for k in held]).alias("v")) for p, q, held in both]))
    pairs = panel.where(F.col("t") % step == 0).select("t", rows.alias("s")).select("t", "s.*")

    def products(table: pa.Table) -> pa.Table:
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        m = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)
        there = ~np.isnan(m)
        for k in range(m.shape[1]):
            m[:, k][there[:, k]] = average_shares(m[:, k][there[:, k]])
        m[~there] = 0
        ones = there.astype(float)
        left, right = slice(0, len(groups[p])), slice(0 if p == q else len(groups[p]), m.shape[1])
        x, y, u, v = m[:, left], m[:, right], ones[:, left], ones[:, right]
        n, sx, sy = u.T @ v, x.T @ v, u.T @ y
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy = (x * x).T @ v - sx * sx / n, u.T @ (y * y) - sy * sy / n
            r = (x.T @ y - sx * sy / n) / np.sqrt(vx * vy)
        a, b = np.nonzero((n >= least) & (vx > 1e-12) & (vy > 1e-12))
        first, second = a + p * block, b + q * block
        keep = first < second
        return pa.table({"i": pa.array(first[keep], pa.int32()), "j": pa.array(second[keep], pa.int32()), "x": r[a, b][keep]})

    day = pairs.groupBy("t", "p", "q").applyInArrow(products, "i int, j int, x double")
    label = F.array(*[F.lit(k) for k in names])
    return day.groupBy("i", "j").agg(F.avg("x").alias("corr"), F.count("*").alias("days")).select(label[F.col("i")].alias("a"), label[F.col("j")].alias("b"), "corr", "days")


def average_shares(v: np.ndarray) -> np.ndarray:
    """Ranks with ties averaged over the number of values, less one half."""
    _, at, ties = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(ties) - (ties - 1) / 2)[at] / max(1, len(v)) - 0.5


def two_sided(z: str) -> Column:
    """erfc(|z| / sqrt 2) of a column, by rational fits to some 15 digits."""
    return F.expr(normal.two_sided_p(z))


def bootstrap_test(ic: DataFrame, reps: int = 2000, block: int = 6, seed: int = 7) -> DataFrame:
    """Rows (factor, real_mean, null_mean, se, reps, z, p): z is the mean over the standard error of ``block_bootstrap``, null under 10 days or without variance."""
    real = ic.groupBy("factor").agg(F.avg("ic").alias("real_mean"), F.stddev_pop("ic").alias("std"), F.count("*").alias("n"))
    null = block_bootstrap(ic, reps, block, seed).groupBy("factor").agg(F.avg("mean").alias("null_mean"), F.stddev_samp("mean").alias("se"), F.count("mean").alias("reps"))
    z = F.when((F.col("n") >= 10) & (F.col("std") > 0) & (F.col("se") > 0), F.col("real_mean") / F.col("se"))
    return real.join(null, "factor").withColumn("z", z).withColumn("p", two_sided("z")).drop("std", "n")


def block_bootstrap(ic: DataFrame, reps: int = 2000, block: int = 6, seed: int = 7) -> DataFrame:
    """Rows (factor, rep, mean): circular blocks of an IC series, block starts from a hash."""
    d = ic.withColumn("i", F.row_number().over(Window.partitionBy("factor").orderBy("t")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("factor")))
    draws = d.select("factor", "n").distinct().select("factor", "n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    draws = draws.select("factor", "n", "rep", F.explode(F.expr(f"sequence(0, cast(ceil(n / {block}) as int) - 1)")).alias("j"))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n")
    picks = draws.select("factor", "n", "rep", "j", start.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("m")).where(F.col("j") * block + F.col("m") < F.col("n"))
    picks = picks.select("factor", "rep", F.pmod(F.col("s") + F.col("m"), F.col("n")).cast("int").alias("i"))
    return picks.join(d.select("factor", "i", "ic"), ["factor", "i"]).groupBy("factor", "rep").agg(F.avg("ic").alias("mean"))


def vol_regimes(panel: DataFrame, window: int = 20) -> DataFrame:
    """Rows (t, vol, regime): centred mean of the daily mean absolute log return, cut at the terciles of the sample; a missing one counts as high."""
    half = window // 2
    r = panel.withColumn("r", F.abs(F.ln("c") - F.ln(F.lag("c", 1).over(Wt()))))
    day = r.groupBy("t").agg(F.avg("r").alias("m"))
    # A table of days: a window without a partition holds only the calendar.
    day = day.withColumn("vol", F.avg("m").over(Window.orderBy("t").rowsBetween(-half, half - 1)))
    cuts = day.agg(F.percentile("vol", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    return day.crossJoin(F.broadcast(cuts)).select("t", "vol", F.when(F.col("vol") < F.col("q")[0], "low").when(F.col("vol") < F.col("q")[1], "mid").otherwise("high").alias("regime"))


def ewm(x: Column, span: int, least: int) -> Column:
    """Exponentially weighted mean over present values, weights counting all rows: sums scaled by the weight of their row."""
    up = F.pow(F.lit((span + 1.0) / (span - 1.0)), F.col("t").cast("double"))
    over = Wt().rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(x).over(over)
    return F.when(n >= least, F.sum(x * up).over(over) / F.sum(F.when(x.isNotNull(), up)).over(over))


def market_beta(panel: DataFrame, span: int = 252, least: int = 252) -> DataFrame:
    """The panel with ``beta``: EWM covariance with the equal-weight market over its EWM variance, one row late."""
    r = panel.withColumn("_r", F.try_divide(F.col("c"), F.lag("c", 1).over(Wt())) - 1).withColumn("_m", F.avg("_r").over(Window.partitionBy("t")))
    e = lambda c: ewm(c, span, least)
    r = r.withColumn("_em", e(F.col("_m"))).withColumn("_er", e(F.col("_r"))).withColumn("_emr", e(F.col("_m") * F.col("_r"))).withColumn("_emm", e(F.col("_m") * F.col("_m")))
    beta = F.try_divide(F.col("_emr") - F.col("_em") * F.col("_er"), F.col("_emm") - F.col("_em") * F.col("_em"))
    return r.withColumn("_b", beta).withColumn("beta", F.lag("_b", 1).over(Wt())).select(*panel.columns, "beta")
