"""Single instruments: continuous contracts, non-overlapping products, positions; and the portfolio simulator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import Wt, finite, normal


def continuous(contracts: DataFrame) -> DataFrame:
    """One adjusted series from rows (contract, date, o, h, l, c, v, oi): each day the contract of most open interest.

    A day without open interest goes by volume, one without either keeps the contract of the day before; ties go to the
    first contract by name. At a roll, earlier prices are not touched; later ones are scaled by the ratio of the old to
    the new contract's last close so far. ``close2`` is the runner-up's close on the same scale. Fails if the first day
    has nothing to choose by, or a roll no closes above zero. The days of one instrument are one task's work.
    """
    day, path = Window.partitionBy("date"), Window.orderBy("date")
    rows = contracts.select("contract", F.col("date").cast("date").alias("date"), *[finite(F.col(k).cast("double")).alias(k) for k in ("o", "h", "l", "c", "v", "oi")]).where("date is not null")
    rows = rows.withColumn("basis", F.when(F.count("oi").over(day) > 0, F.col("oi")).otherwise(F.col("v")))
    rows = rows.withColumn("place", F.when(F.col("basis").isNotNull(), F.row_number().over(day.orderBy(F.desc_nulls_last("basis"), "contract"))))
    at = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    days = rows.groupBy("date").agg(at(1, "contract").alias("chosen"), at(2, "c").alias("c2")).withColumn("kept", F.last("chosen", ignorenulls=True).over(path))
    days = days.withColumn("main", F.coalesce("kept", F.raise_error(F.lit("no open interest or volume to choose the first contract by")).cast("string")))
    days = days.withColumn("before", F.lag("main", 1).over(path)).withColumn("roll", F.coalesce(F.col("before") != F.col("main"), F.lit(False)))

    # The last close so far is asked for on roll days alone: the questions stand among the rows of their contract.
    asked = days.where("roll").select("date", F.explode(F.array("before", "main")).alias("contract"), F.lit(None).cast("double").alias("c"), F.lit(True).alias("asked"))
    told = rows.select("date", "contract", "c", F.lit(False).alias("asked")).unionByName(asked)
    told = told.withColumn("seen", F.last("c", ignorenulls=True).over(Window.partitionBy("contract").orderBy("date"))).where("asked")
    of = lambda k, name: told.select("date", F.col("contract").alias(k), F.col("seen").alias(name))
    j = days.join(of("before", "old"), ["date", "before"], "left").join(of("main", "new"), ["date", "main"], "left")
    priced = F.when((F.col("old") > 0) & (F.col("new") > 0), F.ln(F.col("old") / F.col("new"))).otherwise(F.raise_error(F.lit("a roll without two closes above zero")).cast("double"))
    j = j.withColumn("g", F.when(F.col("roll"), priced).otherwise(0.0)).withColumn("factor", F.exp(F.sum("g").over(path)))
    j = j.join(rows.select("date", F.col("contract").alias("main"), "o", "h", "l", "c", "v", "oi"), ["date", "main"], "left")
    return j.select("date", F.col("main").alias("contract"), "roll", "factor", *[(F.col(p) * F.col("factor")).alias(p) for p in "ohlc"], "v", "oi", (F.col("c2") * F.col("factor")).alias("close2"))


def rolling_z(x: Column, window: int = 250, least: int = 60) -> Column:
    over = Wt().rowsBetween(-(window - 1), 0)
    return F.when(F.count(x).over(over) >= least, F.try_divide(x - F.avg(x).over(over), F.stddev_samp(x).over(over)))


def product_series(panel: DataFrame, factor: str, horizon: int, start: int = 0, limit: float | None = None, window: int = 250, least: int = 60) -> DataFrame:
    """Rows (symbol, t, date, p): rolling z of the factor times the forward return, every ``horizon`` rows from ``start``; dropped if a limit is hit on the way."""
    d = panel.withColumn("z", rolling_z(F.col(factor), window, least)).withColumn("fwd", F.try_divide(F.lead("c", horizon).over(Wt()), F.lead("o", 1).over(Wt())) - 1)
    hit = F.lit(0) if limit is None else F.coalesce((F.abs(F.try_divide(F.col("c"), F.lag("c", 1).over(Wt())) - 1) >= 0.95 * limit).cast("int"), F.lit(0))
    d = d.withColumn("hit", hit).withColumn("hits", F.coalesce(F.sum("hit").over(Wt().rowsBetween(1, horizon)), F.lit(0)))
    return d.where((F.col("t") >= start) & ((F.col("t") - start) % horizon == 0) & (F.col("hits") == 0)).select("symbol", "t", "date", (F.col("z") * F.col("fwd")).alias("p")).where("p is not null")


def positions(panel: DataFrame, factor: str, horizon: int, cost_bps: float = 2.0) -> DataFrame:
    """Rows (symbol, t, date, pos, turn, net): the sign of the factor held for ``horizon`` rows, cost on each change."""
    d = panel.withColumn("fwd", F.try_divide(F.lead("c", horizon).over(Wt()), F.lead("o", 1).over(Wt())) - 1)
    d = d.where((F.col("t") % horizon == 0) & F.col("fwd").isNotNull() & F.col(factor).isNotNull()).withColumn("pos", F.signum(factor))
    d = d.withColumn("turn", F.abs(F.col("pos") - F.coalesce(F.lag("pos", 1).over(Wt()), F.lit(0.0))))
    return d.select("symbol", "t", "date", "pos", "turn", (F.col("pos") * F.col("fwd") - F.col("turn") * cost_bps / 1e4).alias("net"))


LEDGER = "strategy string, t int, equity double, ret double, turnover double, fees double, slippage double, trades int"


def product_ir(products: DataFrame, *by: str) -> DataFrame:
    """Rows (symbol, ir, n) of ``product_series``: mean over deviation, null under two rows or without variance."""
    sd = F.stddev_samp("p")
    return products.groupBy("symbol", *by).agg(F.when((F.count("*") >= 2) & (sd > 0), F.avg("p") / sd).alias("ir"), F.count("*").alias("n"))


def shifted_products(panel: DataFrame, factor: str, horizon: int, shifts: tuple[int, ...] = (0, 5, 10, 21), end=None) -> DataFrame:
    """Rows (symbol, shift, ir, n): the products' IR with the factor as it was ``shift`` rows before. What is real falls towards zero; what stays fits slow drifts."""
    rows = [F.struct(F.lit(k).alias("shift"), (F.lag(factor, k).over(Wt()) if k else F.col(factor)).alias("f")) for k in shifts]
    d = panel.withColumn("_s", F.array(*rows)).select("symbol", "t", "date", "o", "c", F.explode("_s").alias("s")).select(F.struct("symbol", "s.shift").alias("symbol"), "t", "date", "o", "c", "s.f")
    p = product_series(d, "f", horizon)
    got = product_ir(p if end is None else p.where(F.col("date") <= F.lit(end)))
    return got.select("symbol.symbol", "symbol.shift", "ir", "n")


def block_permuted_ir(panel: DataFrame, factor: str, horizon: int, reps: int = 200, seed: int = 42, end=None) -> DataFrame:
    """Rows (symbol, rep, ir): IR of the products once the factor's blocks of ``horizon`` rows stand in another order; rep -1 is the true one.

    The last block may be shorter and moves as it is. What is inside a block stays, what lies between blocks and returns
    breaks. Orders are those of a hash of (seed, rep, block); a repetition is a partition of its own, z is made anew in each.
    """
    base = panel.select("symbol", "t", "date", "o", "c", F.col(factor).alias("f"))
    size = base.groupBy("symbol").agg((F.max("t") + 1).alias("rows"))
    blocks = size.select("symbol", "rows", F.explode(F.expr(f"sequence(0, cast(ceil(rows / {horizon}) as int) - 1)")).alias("block"), F.expr(f"rows % {horizon}").alias("odd"))
    blocks = blocks.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    of = Window.partitionBy("symbol", "rep")
    dice = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("block").cast("string")))
    placed = blocks.withColumn("place", F.row_number().over(of.orderBy(dice, "block")) - 1)
    placed = placed.withColumn("late", F.max(F.when((F.col("odd") > 0) & (F.col("block") == F.expr(f"rows div {horizon}")), F.col("place"))).over(of))
    start = F.col("place") * horizon - F.when(F.col("late") < F.col("place"), horizon - F.col("odd")).otherwise(0)
    moved = base.select("symbol", "t", "f").withColumn("block", F.expr(f"t div {horizon}")).join(placed.select("symbol", "rep", "block", start.alias("start")), ["symbol", "block"])
    moved = moved.select("symbol", "rep", (F.col("start") + F.col("t") % horizon).cast("int").alias("t"), "f").unionByName(base.select("symbol", F.lit(-1).alias("rep"), "t", "f"))
    d = moved.join(base.drop("f"), ["symbol", "t"]).select(F.struct("symbol", "rep").alias("symbol"), "t", "date", "o", "c", "f")
    p = product_series(d, "f", horizon)
    return product_ir(p if end is None else p.where(F.col("date") <= F.lit(end))).select("symbol.symbol", "symbol.rep", "ir", "n")


def block_test(irs: DataFrame, least: int = 5, least_reps: int = 20) -> DataFrame:
    """Rows (symbol, real_ir, n, null_mean, null_std, reps, z, p) of ``block_permuted_ir``: z is null under ``least`` observations, ``least_reps`` repetitions or without variance."""
    real = irs.where("rep = -1").select("symbol", F.col("ir").alias("real_ir"), "n")
    null = irs.where("rep >= 0 and ir is not null").groupBy("symbol").agg(F.avg("ir").alias("null_mean"), F.stddev_samp("ir").alias("null_std"), F.count("*").alias("reps"))
    ok = (F.col("n") >= least) & (F.col("reps") >= least_reps) & (F.col("null_std") > 0)
    d = real.join(null, "symbol", "left").withColumn("z", F.when(ok, (F.col("real_ir") - F.col("null_mean")) / F.col("null_std")))
    return d.withColumn("p", F.when(F.col("z").isNotNull(), F.expr(normal.two_sided_p("z"))))


def position_summary(held: DataFrame, least: int = 5) -> DataFrame:
    """Rows (symbol, gross_ir, net_ir, turn, n) of ``positions`` with its forward return ``fwd``; no row under ``least`` periods."""
    ir = lambda c: F.when(F.stddev_samp(c) > 0, F.avg(c) / F.stddev_samp(c))
    return held.groupBy("symbol").agg(ir("gross").alias("gross_ir"), ir("net").alias("net_ir"), F.avg("turn").alias("turn"), F.count("*").alias("n")).where(F.col("n") >= least)


def evaluate_series(panel: DataFrame, factor: str, horizon: int, end, bar: float, reps: int = 200, seed: int = 42, cost_bps: float = 2.0) -> DataFrame:
    """By symbol, over days up to ``end``: the products' mean, IR and n, share of years of the same sign, the block test, positions, deflated p, flags and verdict.

    The verdict's rules are those of panels, with the block test's z in the place of the permutation's; there is no beta and no portfolio.
    """
    from .evaluation import ic_stats, yearly_consistency
    from .inference import series_moments, verdicts

    p = product_series(panel, factor, horizon).where(F.col("date") <= F.lit(end)).select(F.col("symbol").alias("factor"), "t", "date", F.col("p").alias("ic"))
    tested = block_test(block_permuted_ir(panel, factor, horizon, reps, seed, end))
    held = positions(panel.where(F.col("date") <= F.lit(end)), factor, horizon, cost_bps).withColumn("gross", F.col("net") + F.col("turn") * cost_bps / 1e4)
    none = p.select("factor").distinct()
    stats = ic_stats(p)
    judged = verdicts(stats, tested.select(F.col("symbol").alias("factor"), "z"), none.withColumn("net_annual", F.lit(None).cast("double")), none.withColumn("exposure", F.lit(None).cast("double")), series_moments(p), bar)
    d = judged.select("factor", "ir", "n", "z", F.col("p").alias("deflated_p"), "flags", "warnings", "refused", "verdict").join(stats.select("factor", "mean"), "factor").join(yearly_consistency(p).select("factor", F.col("share").alias("yearly_share")), "factor")
    h = position_summary(held).select(F.col("symbol").alias("factor"), "gross_ir", "net_ir", "turn")
    return d.join(h, "factor", "left").withColumnRenamed("factor", "symbol")


def simulate(weights: DataFrame, panel: DataFrame, cash: float = 1e6, commission_bps: float = 2.5, slippage_bps: float = 5.0, interest: float = 0.015, per_year: int = 252, leverage: float = 1.0) -> DataFrame:
    """Account ledger of each strategy from target weights (strategy, t, symbol, weight).

    The weights of a close are the targets of the next open; a name without a weight is to be sold, on a bar without
    any weights all are. Locked (h = l), unlisted or unpriced names keep what is held, and are tried again as long as
    a later target differs. Sales come first, then purchases, scaled to the cash there is. Amounts are paid at prices
    with slippage, so a sale of all that is held goes a little below zero, and the next bar makes it good. Turnover
    counts one side; ``ret`` of the first bar is null. Weights below zero, or with a sum over ``leverage``, fail.
    Each strategy's path depends on its own past, so it is one group; many strategies run side by side. A strategy's
    rows are its bars, which one task must hold.
    """
    bars = panel.select("t", "symbol", "o", "h", "l", "c", "listed")
    rows = weights.select("strategy", "symbol").distinct().join(bars, "symbol").join(weights, ["strategy", "t", "symbol"], "left")
    fee, slip = commission_bps / 1e4, slippage_bps / 1e4

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        wide = {k: frame.pivot(index="t", columns="symbol", values=k).sort_index() for k in ("o", "h", "l", "c", "listed", "weight")}
        o, h, lo, c, w = (wide[k].to_numpy(float) for k in ("o", "h", "l", "c", "weight"))
        w = np.nan_to_num(w)
        if (w < -1e-12).any() or (w.sum(axis=1) > leverage + 1e-6).any():
            raise ValueError(f"weights of {frame['strategy'].iloc[0]} are below zero or exceed {leverage} together")
        open_ = np.where(wide["listed"].isna(), True, wide["listed"]).astype(bool) & np.isfinite(o) & (o > 0) & np.isfinite(h) & np.isfinite(lo) & (h != lo)
        units, money, before = np.zeros(o.shape[1]), cash, np.nan
        last = np.where(np.isfinite(c[0]), c[0], 0.0)
        out = []
        for i, t in enumerate(wide["c"].index):
            paid = slid = traded = 0.0
            deals = 0
            if i:
                can = open_[i]
                price = np.where(can, o[i], last)
                worth = money + float(units @ price)
                step = np.where(can, w[i - 1] * worth - units * price, 0.0)
                step[np.abs(step) <= 1e-9 * max(worth, 1.0)] = 0.0
                sold, wanted = np.maximum(-step, 0.0), np.maximum(step, 0.0)
                money += sold.sum() * (1 - fee)
                need = wanted.sum() * (1 + fee)
                bought = wanted * max(0.0, min(1.0, money / need)) if need > 0 else wanted
                money -= bought.sum() * (1 + fee)
                at = np.where(can, o[i], 1.0)
                units = units - sold / (at * (1 - slip)) + bought / (at * (1 + slip))
                notional = float(sold.sum() + bought.sum())
                paid, slid = notional * fee, float(sold.sum() * slip / (1 - slip) + bought.sum() * slip / (1 + slip))
                deals = int((sold > 0).sum() + (bought > 0).sum())
                traded = notional / worth / 2 if worth > 0 else 0.0
            money += max(0.0, money) * interest / per_year
            last = np.where(np.isfinite(c[i]) & (c[i] > 0), c[i], last)
            equity = money + float(units @ last)
            out.append((frame["strategy"].iloc[0], int(t), equity, equity / before - 1, traded, paid, slid, deals))
            before = equity
        return pd.DataFrame(out, columns=["strategy", "t", "equity", "ret", "turnover", "fees", "slippage", "trades"])

    return rows.select("strategy", "t", "symbol", "o", "h", "l", "c", "listed", "weight").groupBy("strategy").applyInPandas(run, LEDGER)


def account(ledger: DataFrame, cash: float = 1e6, per_year: int = 252) -> DataFrame:
    """By strategy: returns, volatility, Sharpe ratio (null without volatility), greatest loss from a peak, trades, turnover of the bars that trade, and costs."""
    peak = F.max("equity").over(Window.partitionBy("strategy").orderBy("t"))
    years, sd = (F.count("*") - 1) / F.lit(float(per_year)), F.stddev_samp("ret")
    first, last = F.min_by("equity", "t"), F.max_by("equity", "t")
    return ledger.withColumn("loss", 1 - F.col("equity") / peak).groupBy("strategy").agg(
        last.alias("final_equity"), (last / cash - 1).alias("total_return"), F.when((years > 0) & (first > 0), F.pow(last / first, 1 / F.when(years > 0, years)) - 1).otherwise(0.0).alias("annual_return"),
        F.coalesce(sd * per_year**0.5, F.lit(0.0)).alias("annual_vol"), F.when(sd > 0, F.avg("ret") / sd * per_year**0.5).alias("sharpe"), F.max("loss").alias("max_drawdown"),
        F.sum("trades").alias("trades"), F.count(F.when(F.col("turnover") > 0, 1)).alias("trade_bars"), F.coalesce(F.avg(F.when(F.col("turnover") > 0, F.col("turnover"))), F.lit(0.0)).alias("turnover"),
        F.sum("fees").alias("fees"), F.sum("slippage").alias("slippage"),
    )
