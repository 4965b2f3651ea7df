"""Evidence gathered segment by segment, with an early stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal

# The level that passes, half the width of the band decided by lot, and the shares of the development ratio that are a disaster or weak.
PASS_T, TAIL_PASS_T, BAND, DISASTER, WEAK = 2.6, 2.5, 0.3, 0.5, 0.25


def judge_segments(series: DataFrame, development: DataFrame, segments: list[tuple[str, str, str]], version: str = "segments-1", pass_t: float = PASS_T) -> DataFrame:
    """Rows (factor, verdict, segments, randomized, disaster, t, weak) of ``series(factor, date, value)`` over (id, first date, last date) in order.

    Values are turned to the sign of ``development(factor, dev_ir)``. In each segment: fewer than three values end the
    case as stale; a mean over deviation below -DISASTER * |dev_ir| rejects; the t of all values so far passes at pass_t +
    BAND, and within BAND of pass_t by lot, with a chance that rises from 0 to 1 in the normal distribution's terms. The
    lot is a hash of (factor, version, segment), so it can't be drawn twice. Without an end in any segment the factor is
    rejected. ``segments`` counts those looked at, t is of those that did not end in a disaster or stale, weak lists the
    ids below WEAK * |dev_ir|. What decides a segment does not depend on earlier ones but by the pooled sums, so running
    sums by factor give all segments at once and the first end stands.
    """
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("id"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for i, (k, a, b) in enumerate(segments)])
    sign = F.when(F.col("dev_ir") >= 0, 1.0).otherwise(-1.0)
    grid = development.where("dev_ir is not null").select("factor", F.abs("dev_ir").alias("dev"), sign.alias("sign"), F.explode(rows).alias("s")).select("factor", "dev", "sign", "s.*")
    values = series.where("value is not null").select("factor", F.col("date").cast("date").alias("date"), "value")
    d = grid.join(values, (grid.factor == values.factor) & (F.col("date") >= F.col("a")) & (F.col("date") <= F.col("b")), "left").withColumn("v", F.col("value") * F.col("sign"))
    s = d.groupBy(grid.factor, "dev", "place", "id").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("x"), F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("xx"))
    upto = Window.partitionBy("factor").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    for c in ("n", "x", "xx"):
        s = s.withColumn(f"all_{c}", F.sum(c).over(upto))
    flat = F.when(F.col("m") > 0, float("inf")).when(F.col("m") < 0, float("-inf")).otherwise(0.0)
    s = s.withColumn("ir", F.when(F.col("sd") > 0, F.col("m") / F.col("sd")).otherwise(flat))
    var = F.when(F.col("all_n") > 1, (F.col("all_xx") - F.col("all_x") * F.col("all_x") / F.col("all_n")) / (F.col("all_n") - 1))
    s = s.withColumn("t", F.when(var > 1e-24, F.col("all_x") / F.sqrt(var * F.col("all_n"))).otherwise(0.0))
    s = s.withColumn("lot", F.conv(F.substring(F.md5(F.concat_ws(":", "factor", F.lit(version), F.col("place").cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32)
    below = lambda t: f"(1 - ({normal.upper_p(t)}))"
    low, high = (below(f"{pass_t + x}") for x in (-BAND, BAND))
    s = s.withColumn("chance", F.expr(f"({below('t')} - {low}) / ({high} - {low})"))
    end = (
        F.when(F.col("n") < 3, "stale").when((F.col("dev") > 0) & (F.col("ir") < -DISASTER * F.col("dev")), "disaster")
        .when(F.col("t") >= pass_t + BAND, "pass").when((F.col("t") > pass_t - BAND) & (F.col("lot") < F.col("chance")), "lot")
    )
    s = s.withColumn("end", end)
    s = s.withColumn("stop", F.min(F.when(F.col("end").isNotNull(), F.col("place"))).over(Window.partitionBy("factor")))
    seen = s.where("stop is null or place <= stop")
    counted = ~F.coalesce(F.col("end").isin("stale", "disaster"), F.lit(False))
    last = F.max_by("t", F.when(counted, F.col("place")))
    weak = F.array_sort(F.collect_list(F.when(counted & (F.col("ir") < WEAK * F.col("dev")), F.struct("place", "id"))))
    g = seen.groupBy("factor").agg(F.max("end").alias("end"), F.count("*").alias("segments"), last.alias("t"), F.transform(weak, lambda w: w["id"]).alias("weak"))
    verdict = F.when(F.col("end") == "stale", "stale").when(F.col("end").isin("pass", "lot"), "pass").otherwise("reject")
    return g.select("factor", verdict.alias("verdict"), "segments", F.coalesce(F.col("end") == "lot", F.lit(False)).alias("randomized"), F.coalesce(F.col("end") == "disaster", F.lit(False)).alias("disaster"), "t", "weak")


def incubate(days: DataFrame, cohorts: DataFrame, alpha: float = 0.0253, least: int = 20) -> DataFrame:
    """Rows (cohort, factor, ready, n, ir, t, bar, survived): members judged once, on days from their cohort's start on.

    ``cohorts(cohort, factor, sign, start, window_days)``, ``days(factor, date, ic, fresh)`` with a row for each calendar
    day, ic null on days without one. A cohort is ready when its calendar has ``window_days`` days from the start on. t is
    sign * ir * sqrt(n) and must exceed the normal quantile of 1 - alpha / members; a member needs ``least`` ICs that vary.
    Until ready, all but ready is null. State: n, sums and squares are all that is kept of past days, see ``add_days``.
    """
    sums = add_days(None, days, cohorts)
    return judge(sums, cohorts, alpha, least)


def add_days(state: DataFrame | None, days: DataFrame, cohorts: DataFrame) -> DataFrame:
    """State (cohort, factor, calendar, n, x, xx) with new days added: the only thing later batches need of earlier ones. Days must not come twice."""
    own = cohorts.select("cohort", "factor", F.col("start").cast("date").alias("start"))
    met = own.join(days.select("factor", F.col("date").cast("date").alias("date"), "ic"), "factor").where("date >= start")
    new = met.groupBy("cohort", "factor").agg(F.countDistinct("date").alias("calendar"), F.count("ic").alias("n"), F.coalesce(F.sum("ic"), F.lit(0.0)).alias("x"), F.coalesce(F.sum(F.col("ic") * F.col("ic")), F.lit(0.0)).alias("xx"))
    if state is None:
        return new
    return state.select(*new.columns).unionByName(new).groupBy("cohort", "factor").agg(*[F.sum(c).alias(c) for c in ("calendar", "n", "x", "xx")])


def judge(state: DataFrame, cohorts: DataFrame, alpha: float = 0.0253, least: int = 20) -> DataFrame:
    """The rows of ``incubate`` from the sums of ``add_days``."""
    of = Window.partitionBy("cohort")
    d = cohorts.select("cohort", "factor", "sign", "window_days").join(state, ["cohort", "factor"], "left").na.fill(0, ["calendar", "n"])
    d = d.withColumn("members", F.count("*").over(of)).withColumn("ready", F.max("calendar").over(of) >= F.col("window_days"))
    var = F.when(F.col("n") > 1, (F.col("xx") - F.col("x") * F.col("x") / F.col("n")) / (F.col("n") - 1))
    ir = F.when((F.col("n") >= least) & (var > 1e-24), F.col("x") / F.col("n") / F.sqrt(var))
    d = d.withColumn("ir", ir).withColumn("t", F.col("sign") * F.col("ir") * F.sqrt("n")).withColumn("bar", F.expr(normal.quantile(f"(1 - {alpha} / members)")))
    shown = [F.when(F.col("ready"), F.col(c)).alias(c) for c in ("n", "ir", "t", "bar")]
    return d.select("cohort", "factor", "ready", *shown, F.when(F.col("ready"), F.coalesce(F.col("t") > F.col("bar"), F.lit(False))).alias("survived"))
