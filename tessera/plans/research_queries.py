"""Evaluation queries over the weekly panel and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import series as S
from ..sources.market import PANEL_SQL, bars, panel
from ..sources.panel import holes, tradable
from .expr import evaluate

W, H, STEP, D = 20, 4, 4, 6
FACTORS = {"momentum": f"ts_momentum[{W}](c)", "volume_z": "ts_zscore[10](v)"}


def rounded(df, digits=D):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def valued(spark, d):
    return evaluate(panel(spark, d), FACTORS)


def valid(spark, d):
    return E.cells(valued(spark, d), list(FACTORS), H, STEP, tradable())


def daily(spark, d):
    return E.day_ic(valued(spark, d), list(FACTORS), H, STEP, tradable())


def flagship(spark, d):
    p = evaluate(panel(spark, d, "l_partkey", "month", carry=True), {"momentum": "ts_momentum[6](c)"})
    return E.ic_stats(E.rank_ic(E.cells(p, ["momentum"], 3, 3, tradable())))


def forward(spark, d):
    p = panel(spark, d)
    return p.select("symbol", "t", F.round(E.forward_return(H), D).alias("t1"), F.round(E.forward_return(H, "t0"), D).alias("t0"))


def market_day(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    one = li.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.avg(price).alias("c"), F.min(price).alias("l"), F.max(price).alias("h"), F.sum("l_quantity").cast("double").alias("v"), F.count("*").cast("double").alias("oi"))
    one = one.withColumn("t", (F.row_number().over(Window.orderBy("date")) - 1).cast("int")).withColumn("symbol", F.lit("all"))
    return one.withColumn("o", F.col("c"))


def contracts(spark, d):
    li, part = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/part.parquet")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    j = li.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("contract")), "l_partkey")
    return j.groupBy("contract", F.date_trunc("month", "l_shipdate").cast("date").alias("date")).agg(
        F.avg(price).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.avg(price).alias("c"), F.count("*").cast("double").alias("v"), F.sum("l_quantity").cast("double").alias("oi")
    )


def continued(spark, d):
    """Prices as logarithms: the brands' prices lie so far apart that factors grow to millions, where SQL's last digits differ."""
    j = S.continuous(contracts(spark, d))
    return rounded(j.select("date", "contract", "roll", "v", "oi", *[F.ln(k).alias(f"ln_{k}") for k in ("factor", "o", "h", "l", "c", "close2")]))


def simulated(spark, d):
    """Equal weights of the ten best by momentum, kept until the next choice; and the same at half the size."""
    v = valid(spark, d).where("factor = 'momentum'")
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("f"), "symbol"))
    w = v.withColumn("rn", rank).where("rn <= 10").select(F.explode(F.sequence("t", F.col("t") + (STEP - 1))).alias("t"), "symbol")
    sizes = F.explode(F.array(F.struct(F.lit("top10").alias("strategy"), F.lit(0.1).alias("weight")), F.struct(F.lit("top10_half").alias("strategy"), F.lit(0.05).alias("weight"))))
    return S.simulate(w.select("t", "symbol", sizes.alias("s")).select("s.strategy", "t", "symbol", "s.weight"), panel(spark, d))


QUERIES = {
    "panel_week": lambda s, d: rounded(panel(s, d), 9),
    "panel_holes": lambda s, d: holes(panel(s, d)),
    "forward_return": forward,
    "rank_ic": lambda s, d: rounded(daily(s, d)),
    "ic_stats": lambda s, d: rounded(E.ic_stats(daily(s, d))),
    "ic_yearly": lambda s, d: rounded(E.yearly_consistency(daily(s, d))),
    "ic_rolling": lambda s, d: rounded(E.rolling_stability(daily(s, d), 20)),
    "ic_decay": lambda s, d: rounded(E.decay(daily(s, d))),
    "ic_walk_forward": lambda s, d: rounded(E.walk_forward(daily(s, d), 5)),
    "ic_drawdown": lambda s, d: rounded(E.drawdown_ratio(daily(s, d))),
    "shift_placebo": lambda s, d: rounded(E.shift_placebo(valued(s, d), list(FACTORS), H, STEP, tradable())),
    "top_k_days": lambda s, d: rounded(E.top_k(valid(s, d))),
    "top_k_summary": lambda s, d: rounded(E.top_k_summary(E.top_k(valid(s, d)), 52 / STEP)),
    "rank_autocorr": lambda s, d: rounded(E.rank_autocorrelation(valued(s, d), list(FACTORS), H, STEP, tradable())),
    "factor_corr": lambda s, d: rounded(E.factor_correlations(valued(s, d), list(FACTORS), STEP)),
    "vol_regimes": lambda s, d: rounded(E.vol_regimes(panel(s, d))),
    "market_beta": lambda s, d: rounded(E.market_beta(panel(s, d), 60, 60).select("symbol", "t", "beta")),
    "series_products": lambda s, d: rounded(S.product_series(evaluate(market_day(s, d), {"f": "ts_momentum[20](c)"}, single=True), "f", 20)),
    "series_positions": lambda s, d: rounded(S.positions(evaluate(market_day(s, d), {"f": "ts_momentum[20](c)"}, single=True), "f", 20)),
    "continuous": continued,
    "block_bootstrap": lambda s, d: rounded(E.bootstrap_test(daily(s, d)).drop("p")),
    "simulate": lambda s, d: rounded(simulated(s, d)),
    "account": lambda s, d: rounded(S.account(simulated(s, d))),
    "bars_week": lambda s, d: rounded(bars(s, d), 9),
}

_VALUED = f"""WITH {PANEL_SQL},
raw AS (SELECT *, lead(o, 1) OVER s AS o1, lead(c, {H}) OVER s AS ch, lag(c, {W}) OVER s AS cw,
    CASE WHEN count(v) OVER w >= 5 THEN (v - avg(v) OVER w) / greatest(stddev_samp(v) OVER w, 1e-12) END AS volume_z
  FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY t), w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
valued AS (SELECT symbol, t, date, amount, ch / o1 - 1 AS fwd, ch / c - 1 AS fwd0, c / cw - 1 AS momentum, volume_z FROM raw),
valid AS (SELECT f.factor, t, date, symbol, f.f, fwd FROM (
    SELECT *, unnest([{{'factor': 'momentum', 'f': momentum}}, {{'factor': 'volume_z', 'f': volume_z}}]) AS f FROM valued)
  WHERE t % {STEP} = 0 AND amount > 0 AND fwd IS NOT NULL AND f.f IS NOT NULL),
pooled AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY factor, t) AS n FROM valid) WHERE n >= 30),
ranked AS (SELECT *, (rank() OVER (PARTITION BY factor, t ORDER BY f) + (count(*) OVER (PARTITION BY factor, t, f) - 1) / 2.0) / n AS rf,
    (rank() OVER (PARTITION BY factor, t ORDER BY fwd) + (count(*) OVER (PARTITION BY factor, t, fwd) - 1) / 2.0) / n AS rr FROM pooled),
ic AS (SELECT factor, t, date, corr(rf, rr) AS ic FROM ranked GROUP BY ALL HAVING stddev_samp(rf) * stddev_samp(rr) > 0),
seq AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY factor) AS n FROM ic),
picked AS (SELECT *, greatest(1, CAST(round_even(n * 0.2, 0) AS INTEGER)) AS k, row_number() OVER (PARTITION BY factor, t ORDER BY f DESC, symbol) AS rn
  FROM (SELECT *, count(*) OVER (PARTITION BY factor, t) AS n FROM valid) WHERE n >= 8),
held AS (SELECT factor, t, date, k, avg(fwd) FILTER (rn <= k) - avg(fwd) AS gross, list(symbol) FILTER (rn <= k) AS held FROM picked GROUP BY factor, t, date, k),
turned AS (SELECT *, lag(held) OVER (PARTITION BY factor ORDER BY t) AS prev FROM held),
days_k AS (SELECT factor, t, date, k, gross, CASE WHEN prev IS NULL THEN 1.0 ELSE (len(held) + len(prev) - 2 * len(list_intersect(held, prev))) / (2.0 * k) END AS turn FROM turned),
topk AS (SELECT *, gross - 2 * turn * 10.0 / 1e4 AS net FROM days_k)
"""
_R = lambda c: f"round({c}, {D}) AS {c}"
_DAY = f"""WITH d AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS c FROM lineitem GROUP BY 1),
e AS (SELECT 'all' AS symbol, date, c, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t FROM d),
f AS (SELECT *, c / lag(c, 20) OVER s - 1 AS f, lead(c, 20) OVER s / lead(c, 1) OVER s - 1 AS fwd FROM e WINDOW s AS (ORDER BY t)),
z AS (SELECT *, CASE WHEN count(f) OVER w >= 60 THEN (f - avg(f) OVER w) / stddev_samp(f) OVER w END AS z FROM f WINDOW w AS (ORDER BY t ROWS BETWEEN 249 PRECEDING AND CURRENT ROW))
"""
ORACLES = {
    "continuous": f"""WITH k AS (SELECT p_brand AS contract, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_extendedprice / l_quantity) AS o, max(l_extendedprice / l_quantity) AS h, min(l_extendedprice / l_quantity) AS l, avg(l_extendedprice / l_quantity) AS c,
        CAST(count(*) AS DOUBLE) AS v, CAST(sum(l_quantity) AS DOUBLE) AS oi FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY oi DESC, contract) AS place FROM k),
      d AS (SELECT date, max(contract) FILTER (place = 1) AS main, max(c) FILTER (place = 2) AS c2 FROM r GROUP BY 1), b AS (SELECT *, lag(main) OVER (ORDER BY date) AS before FROM d),
      s AS (SELECT b.*, coalesce(before <> main, false) AS roll, p.c AS old, q.c AS new FROM b ASOF LEFT JOIN k p ON p.contract = b.before AND b.date >= p.date ASOF LEFT JOIN k q ON q.contract = b.main AND b.date >= q.date),
      f AS (SELECT *, exp(sum(CASE WHEN roll THEN ln(old / new) ELSE 0 END) OVER (ORDER BY date)) AS factor FROM s)
      SELECT f.date, main AS contract, roll, v, oi, round(ln(factor), {D}) AS ln_factor, {', '.join(f'round(ln({x} * factor), {D}) AS ln_{x}' for x in 'ohlc')}, round(ln(c2 * factor), {D}) AS ln_close2 FROM f JOIN k ON k.date = f.date AND k.contract = f.main""",
    "panel_week": f"WITH {PANEL_SQL} SELECT symbol, t, date, {', '.join(f'round({c}, 9) AS {c}' for c in ('o', 'h', 'l', 'c', 'v', 'amount'))}, listed FROM panel",
    "bars_week": f"WITH {PANEL_SQL} SELECT symbol, date, {', '.join(f'round({c}, 9) AS {c}' for c in ('o', 'h', 'l', 'c', 'v', 'amount'))} FROM bars",
    "panel_holes": f"""WITH {PANEL_SQL}, s AS (SELECT symbol, min(t) FILTER (c IS NOT NULL) AS a, max(t) FILTER (c IS NOT NULL) AS b, count(*) AS n, count(c) AS k FROM panel GROUP BY 1)
      SELECT symbol, CAST(a AS BIGINT) AS before_listing, CAST(b - a + 1 - k AS BIGINT) AS inside, CAST(n - 1 - b AS BIGINT) AS after_last FROM s""",
    "forward_return": f"{_VALUED} SELECT symbol, t, round(fwd, {D}) AS t1, round(fwd0, {D}) AS t0 FROM valued",
    "rank_ic": f"{_VALUED} SELECT factor, t, date, {_R('ic')} FROM ic",
    "ic_stats": f"{_VALUED} SELECT factor, round(avg(ic), {D}) AS mean, round(stddev_samp(ic), {D}) AS std, round(avg(ic) / stddev_samp(ic), {D}) AS ir, count(*) AS n FROM ic GROUP BY 1",
    "ic_yearly": f"""{_VALUED}, y AS (SELECT factor, year(date) AS year, avg(ic) AS m FROM ic GROUP BY ALL), g AS (SELECT factor, sign(avg(ic)) AS s FROM ic GROUP BY 1)
      SELECT factor, round(CASE WHEN s = 0 THEN 0.5 ELSE avg(CASE WHEN sign(m) = s THEN 1.0::DOUBLE ELSE 0 END) END, {D}) AS share, count(*) AS years FROM y JOIN g USING (factor) GROUP BY factor, s""",
    "ic_rolling": f"""{_VALUED}, r AS (SELECT factor, avg(ic) OVER w AS m, count(*) OVER w AS k, sign(avg(ic) OVER (PARTITION BY factor)) AS s FROM ic WINDOW w AS (PARTITION BY factor ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
      SELECT factor, round(avg(CASE WHEN sign(m) = s THEN 1.0::DOUBLE ELSE 0 END), {D}) AS share, count(*) AS windows FROM r WHERE k = 20 GROUP BY 1""",
    "ic_decay": f"""{_VALUED}, k AS (SELECT *, CAST(greatest(2, least(8, n // 20)) AS INTEGER) AS k FROM seq), b AS (SELECT factor, k, ((i + 1) * k - 1) // n AS bucket, avg(ic) AS m, max(n) AS n FROM k GROUP BY ALL),
      w AS (SELECT factor, stddev_samp(ic) AS std FROM ic GROUP BY 1),
      g AS (SELECT factor, k, CASE WHEN count(*) >= 3 THEN regr_slope(m, bucket) END AS slope, arg_min(m, bucket) AS first, arg_max(m, bucket) AS last, max(n) AS n FROM b GROUP BY ALL)
      SELECT factor, k, round(slope, {D}) AS slope, round(first, {D}) AS first, round(last, {D}) AS last, round((last - first) / (sqrt(2.0) * std / sqrt(n // k)), {D}) AS z, sign(first) * sign(last) < 0 AS flips FROM g JOIN w USING (factor)""",
    "ic_walk_forward": f"""{_VALUED} SELECT factor, CAST(((i + 1) * 5 - 1) // n AS INTEGER) AS fold, round(avg(ic), {D}) AS mean, round(stddev_samp(ic), {D}) AS std, round(avg(ic) / stddev_samp(ic), {D}) AS ir, count(*) AS n FROM seq GROUP BY ALL""",
    "ic_drawdown": f"""{_VALUED}, a AS (SELECT factor, t, CASE WHEN avg(ic) OVER (PARTITION BY factor) >= 0 THEN ic ELSE -ic END AS a FROM ic),
      c AS (SELECT factor, t, a, sum(a) OVER (PARTITION BY factor ORDER BY t) AS c FROM a), p AS (SELECT *, max(c) OVER (PARTITION BY factor ORDER BY t) AS p FROM c)
      SELECT factor, round(CASE WHEN count(*) >= 5 AND abs(sum(a)) > 1e-9 THEN max(p - c) / abs(sum(a)) END, {D}) AS ratio, count(*) AS n FROM p GROUP BY 1""",
    "shift_placebo": f"""{_VALUED}, l AS (SELECT s.shift, v.t, v.symbol, amount, fwd, lag(momentum, s.shift) OVER w AS momentum, lag(volume_z, s.shift) OVER w AS volume_z
        FROM valued v, (SELECT CAST(unnest([0, 5, 10, 21]) AS INTEGER) AS shift) s WINDOW w AS (PARTITION BY s.shift, v.symbol ORDER BY v.t)),
      u AS (SELECT shift, t, f.factor, f.f, fwd FROM (SELECT *, unnest([{{'factor': 'momentum', 'f': momentum}}, {{'factor': 'volume_z', 'f': volume_z}}]) AS f FROM l)
        WHERE t % {STEP} = 0 AND amount > 0 AND fwd IS NOT NULL AND f.f IS NOT NULL),
      k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY shift, factor, t) AS n FROM u) WHERE n >= 30),
      r AS (SELECT *, rank() OVER (PARTITION BY shift, factor, t ORDER BY f) + (count(*) OVER (PARTITION BY shift, factor, t, f) - 1) / 2.0 AS rf,
        rank() OVER (PARTITION BY shift, factor, t ORDER BY fwd) + (count(*) OVER (PARTITION BY shift, factor, t, fwd) - 1) / 2.0 AS rr FROM k),
      i AS (SELECT shift, factor, t, corr(rf, rr) AS x FROM r GROUP BY ALL HAVING stddev_samp(rf) * stddev_samp(rr) > 0)
      SELECT factor, shift, round(CASE WHEN count(*) >= 2 THEN avg(x) END, {D}) AS mean, count(*) AS n FROM i GROUP BY ALL""",
    "top_k_days": f"{_VALUED} SELECT factor, t, date, k, {_R('gross')}, {_R('turn')}, {_R('net')} FROM topk",
    "top_k_summary": f"""{_VALUED} SELECT factor, round(avg(gross) / stddev_samp(gross), {D}) AS spread_ir, round(avg(net) / stddev_samp(net), {D}) AS net_ir, round(avg(gross) * 13.0 * 100, {D}) AS gross_annual,
      round(avg(net) * 13.0 * 100, {D}) AS net_annual, round(avg(turn), {D}) AS turn, round(avg(gross) * 1e4 / (2 * avg(turn)), {D}) AS break_even_bps, count(*) AS n FROM topk GROUP BY 1""",
    "rank_autocorr": f"""{_VALUED}, k AS (SELECT t, symbol, f.factor, f.f FROM (SELECT t, symbol, unnest([{{'factor': 'momentum', 'f': momentum}}, {{'factor': 'volume_z', 'f': volume_z}}]) AS f FROM valued WHERE amount > 0) WHERE f.f IS NOT NULL),
      j AS (SELECT a.factor, a.t, row_number() OVER (PARTITION BY a.factor, a.t ORDER BY a.f, a.symbol) AS x, row_number() OVER (PARTITION BY a.factor, a.t ORDER BY b.f, a.symbol) AS y FROM k a JOIN k b ON a.factor = b.factor AND a.symbol = b.symbol AND b.t = a.t + {H} WHERE a.t % {STEP} = 0),
      g AS (SELECT factor, t, corr(x, y) AS x FROM j GROUP BY ALL HAVING count(*) >= 8) SELECT factor, round(CASE WHEN count(*) >= 5 THEN avg(x) END, {D}) AS autocorr, count(*) AS days FROM g GROUP BY 1""",
    "factor_corr": f"""{_VALUED}, r AS (SELECT t, symbol, momentum AS p, volume_z AS q,
        (rank() OVER (PARTITION BY t ORDER BY momentum NULLS LAST) + (count(momentum) OVER (PARTITION BY t, momentum) - 1) / 2.0) / count(momentum) OVER (PARTITION BY t) AS a,
        (rank() OVER (PARTITION BY t ORDER BY volume_z NULLS LAST) + (count(volume_z) OVER (PARTITION BY t, volume_z) - 1) / 2.0) / count(volume_z) OVER (PARTITION BY t) AS b FROM valued WHERE t % {STEP} = 0),
      g AS (SELECT t, corr(a, b) AS x, count(*) AS n FROM r WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY 1)
      SELECT 'momentum' AS a, 'volume_z' AS b, round(avg(x), {D}) AS corr, count(*) AS days FROM g WHERE n >= 30 AND NOT isnan(x)""",
    "vol_regimes": f"""WITH {PANEL_SQL}, r AS (SELECT t, abs(ln(c) - ln(lag(c, 1) OVER (PARTITION BY symbol ORDER BY t))) AS r FROM panel), m AS (SELECT t, avg(r) AS m FROM r GROUP BY 1),
      v AS (SELECT t, avg(m) OVER (ORDER BY t ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS vol FROM m), q AS (SELECT quantile_cont(vol, (1/3)::DOUBLE) AS a, quantile_cont(vol, (2/3)::DOUBLE) AS b FROM v)
      SELECT t, {_R('vol')}, CASE WHEN vol < a THEN 'low' WHEN vol < b THEN 'mid' ELSE 'high' END AS regime FROM v, q""",
    "market_beta": f"""WITH {PANEL_SQL}, r AS (SELECT symbol, t, c / lag(c, 1) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r FROM panel), m AS (SELECT *, avg(r) OVER (PARTITION BY t) AS m, pow(61.0 / 59.0, t) AS u FROM r),
      e AS (SELECT symbol, t, {', '.join(f"CASE WHEN count({x}) OVER s >= 60 THEN sum({x} * u) OVER s / sum(CASE WHEN {x} IS NOT NULL THEN u END) OVER s END AS {n}" for x, n in (('m', 'em'), ('r', 'er'), ('m * r', 'emr'), ('m * m', 'emm')))}
        FROM m WINDOW s AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT symbol, t, round(lag((emr - em * er) / (emm - em * em), 1) OVER (PARTITION BY symbol ORDER BY t), {D}) AS beta FROM e""",
    "series_products": f"{_DAY} SELECT symbol, t, date, round(z * fwd, {D}) AS p FROM z WHERE t % 20 = 0 AND z * fwd IS NOT NULL",
    "series_positions": f"""{_DAY}, p AS (SELECT symbol, t, date, CAST(sign(f) AS DOUBLE) AS pos, fwd FROM z WHERE t % 20 = 0 AND fwd IS NOT NULL AND f IS NOT NULL), q AS (SELECT *, abs(pos - coalesce(lag(pos) OVER (ORDER BY t), 0)) AS turn FROM p)
      SELECT symbol, t, date, pos, turn, round(pos * fwd - turn * 2.0 / 1e4, {D}) AS net FROM q""",
    "block_bootstrap": f"""{_VALUED}, b AS (SELECT factor, max(n) AS n, rep, unnest(range(CAST(ceil(max(n) / 6) AS BIGINT))) AS j FROM seq, (SELECT unnest(range(2000)) AS rep) GROUP BY factor, rep),
      s AS (SELECT factor, rep, n, j, unnest(range(6)) AS m, CAST('0x' || substr(md5(concat_ws(':', '7', rep, j)), 1, 8) AS BIGINT) % n AS s FROM b), p AS (SELECT factor, rep, (s + m) % n AS i FROM s WHERE j * 6 + m < n),
      r AS (SELECT p.factor, rep, avg(ic) AS mean FROM p JOIN seq USING (factor, i) GROUP BY ALL), g AS (SELECT factor, avg(mean) AS null_mean, stddev_samp(mean) AS se, count(*) AS reps FROM r GROUP BY 1),
      w AS (SELECT factor, avg(ic) AS real_mean, stddev_pop(ic) AS std, count(*) AS n FROM ic GROUP BY 1)
      SELECT factor, {_R('real_mean')}, {_R('null_mean')}, {_R('se')}, reps, round(CASE WHEN n >= 10 AND std > 0 AND se > 0 THEN real_mean / se END, {D}) AS z FROM w JOIN g USING (factor)""",
}
