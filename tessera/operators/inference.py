"""Nulls, tails, regimes and multiple-testing statistics of factor evaluations.

Random orders come from MD5 of (seed, repetition, key), so that any engine can repeat them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import Wt, average_rank, correlation, normal
from ..functions.hashing import Keys
from ..sources.store import written
from . import rolling
from .days import PARTS, by_day, centred_ranks, numbers, symbols
from .evaluation import MIN_POOL, forward_return, pooled, rank_ic, sampled_days, two_sided, valued_ic
from .ledger import deflated_t, signature_similarity
from .residuals import plain_mask, plain_rank_ic, summed_forward


TILE = 32  # days of values, and of returns, that meet in one task


def drawn(*parts) -> Column:
    """A hash that orders keys at random."""
    return F.md5(F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]))


def by_factor(table: pa.Table, names: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """For each factor of a day with enough cells: its name, the places of its symbols in order, and the centred ranks of factor and return in that order."""
    place, found = symbols(table)
    factor = table.column("factor").combine_chunks().dictionary_encode()
    at, f, fwd = factor.indices.to_numpy(), numbers(table, "f"), numbers(table, "fwd")
    for i, key in enumerate(factor.dictionary.to_pylist()):
        rows = np.flatnonzero(at == i)
        if len(rows) >= names:
            rows = rows[np.argsort(place[rows])]
            yield key, place[rows], centred_ranks(f[rows]), centred_ranks(fwd[rows])


def null_ics(found: list[tuple[str, np.ndarray]], reps: int) -> pa.Table:
    rep = np.tile(np.arange(reps, dtype=np.int32), len(found))
    ic = np.concatenate([x for _, x in found]) if found else np.empty(0)
    return pa.table({"factor": pa.array([k for k, _ in found for _ in range(reps)], pa.string()), "rep": pa.array(rep, pa.int32()), "ic": pa.array(ic, pa.float64())})


def permuted_ic(valid: DataFrame, reps: int, seed: int) -> DataFrame:
    """Rows (factor, rep, mean_ic): returns' ranks dealt anew among a day's names, in the order of MD5 of (seed, rep, t, name).

    A day is one task's work: its names are hashed and put in order once a repetition for all factors, of which each
    takes its own names; only a number for each repetition leaves the task.
    """

    def deal(table: pa.Table) -> pa.Table:
        t, keys = table.column("t")[0].as_py(), Keys(symbols(table)[1])
        days = [(factor, own, rf, rr, (rf @ rf) * (rr @ rr)) for factor, own, rf, rr in by_factor(table, MIN_POOL)]
        held = []
        for factor, own, rf, rr, norm in days:
            if norm > 0:
                within = np.full(len(keys.names), -1)
                within[own] = np.arange(len(own))
                held.append((factor, within, rf, rr, norm**0.5, np.empty(reps)))
        for rep in range(reps) if held else ():
            order = keys.order(f"{seed}:{rep}:{t}:".encode())
            for _, within, rf, rr, norm, ic in held:
                mine = within[order]
                ic[rep] = rf @ rr[mine[mine >= 0]] / norm
        return null_ics([(k[0], k[-1]) for k in held], reps)

    made = by_day(valid.select("factor", "t", "symbol", "f", "fwd"), deal, "factor string, rep int, ic double")
    return made.groupBy("factor", "rep").agg(F.avg("ic").alias("mean_ic"))


def rolled_ic(valid: DataFrame, reps: int, seed: int) -> DataFrame:
    """As ``permuted_ic``, with the day's returns turned by a random number of places (the audit's null)."""

    def turn(table: pa.Table) -> pa.Table:
        t = table.column("t")[0].as_py()
        draws = [int(md5(f"{seed}:{rep}:{t}".encode()).hexdigest()[:8], 16) for rep in range(reps)]
        held = []
        for factor, _, rf, rr in by_factor(table, MIN_POOL):
            if (norm := (rf @ rf) * (rr @ rr)) > 0:
                n, twice = len(rr), np.concatenate([rr, rr])
                held.append((factor, np.array([rf @ twice[k % n : k % n + n] for k in draws]) / norm**0.5))
        return null_ics(held, reps)

    made = by_day(valid.select("factor", "t", "symbol", "f", "fwd"), turn, "factor string, rep int, ic double")
    return made.groupBy("factor", "rep").agg(F.avg("ic").alias("mean_ic"))


def null_test(real: DataFrame, null: DataFrame) -> DataFrame:
    """Rows (factor, real_mean, null_mean, null_std, reps, z, above, p): above is the share of repetitions at least as large, the real one counted; p belongs to z, on both sides."""
    g = null.join(real, "factor").groupBy("factor", "real_mean").agg(F.avg("mean_ic").alias("null_mean"), F.stddev_pop("mean_ic").alias("null_std"), F.count("mean_ic").alias("reps"), F.sum((F.col("mean_ic") >= F.col("real_mean")).cast("int")).alias("k"))
    return g.select("factor", "real_mean", "null_mean", "null_std", "reps", F.when(F.col("null_std") > 0, (F.col("real_mean") - F.col("null_mean")) / F.col("null_std")).alias("z"), ((F.col("k") + 1) / (F.col("reps") + 1)).alias("above")).withColumn("p", two_sided("z"))


def mean_rank_ic(valid: DataFrame) -> DataFrame:
    return rank_ic(valid).groupBy("factor").agg(F.avg("ic").alias("real_mean"))


def day_permutation(panel: DataFrame, factors: list[str], horizon: int, step: int, ok: Column, reps: int, seed: int) -> DataFrame:
    """Rows (factor, rep, ir): mean over deviation of daily IC once whole days of returns change places; rep -1 is the true order.

    All days of the calendar change places, by a hash; a sampled day's tradable values meet the returns of the day that
    came to it, by ordinal ranks (ties by symbol) of two names or more. A day is a row of places over the dense panel's
    symbols, sorted once; two days that meet take their ranks from these places by counting. Null under two days.
    """
    d = panel.withColumn("fwd", forward_return(horizon))
    names = list(factors)

    def placed(table: pa.Table) -> pa.Table:
        own = np.argsort(symbols(table)[0])
        out = []
        for i, key in enumerate([*names, None]):
            v = numbers(table, "fwd" if key is None else f"f{i}")[own]
            if key is not None:
                v[~table.column("ok").to_numpy().astype(bool)[own]] = np.nan
            place = np.full(len(v), -1, np.int32)
            order = np.argsort(v, kind="stable")[: int((~np.isnan(v)).sum())]
            place[order] = np.arange(len(order), dtype=np.int32)
            out.append((key, place))
        t = table.column("t")[0].as_py()
        sampled = [k is None or t % step == 0 for k, _ in out]
        keep = [x for x, s in zip(out, sampled) if s]
        return pa.table({"factor": pa.array([k for k, _ in keep], pa.string()), "t": pa.array([t] * len(keep), pa.int32()), "place": pa.array([p.tobytes() for _, p in keep], pa.binary())})

    wide = d.select("t", "symbol", F.coalesce(ok, F.lit(False)).alias("ok"), F.col("fwd").cast("double").alias("fwd"), *[F.col(k).cast("double").alias(f"f{i}") for i, k in enumerate(names)])
    rows = written(by_day(wide, placed, "factor string, t int, place binary"), "places")
    days = rows.where("factor is null").select("t")
    place = F.row_number().over(Window.partitionBy("rep").orderBy(drawn(seed, F.col("rep"), F.col("u")), "u")) - 1
    moved = days.select(F.col("t").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).withColumn("t", place)
    order = moved.select("rep", "t", "u").unionByName(days.select(F.lit(-1).alias("rep"), "t", F.col("t").alias("u"))).where(F.col("t") % step == 0)
    # pairs of days lie in tiles of TILE days of values by TILE days of returns: a day is sent once to each tile, not once for each pair
    down, across = F.expr(f"t div {step * TILE}"), F.expr(f"u div {TILE}")
    tiles = order.select(down.alias("p"), across.alias("q")).distinct()
    asked = order.select(down.alias("p"), across.alias("q"), "rep", "t", "u", F.lit(None).cast("string").alias("factor"), F.lit(None).cast("binary").alias("place"))
    none = [F.lit(None).cast("int").alias(c) for c in ("rep", "u")]
    values = rows.where("factor is not null").withColumn("p", down).join(F.broadcast(tiles), "p").select("p", "q", none[0], "t", none[1], "factor", "place")
    returns = rows.where("factor is null").select(F.col("t").alias("u"), "place").withColumn("q", across).join(F.broadcast(tiles), "q")
    returns = returns.select("p", "q", none[0], F.lit(None).cast("int").alias("t"), "u", F.lit(None).cast("string").alias("factor"), "place")

    def correlate(table: pa.Table) -> pa.Table:
        left: dict[int, list[tuple[str, np.ndarray]]] = {}
        right, pairs = {}, []
        for rep, t, u, factor, held in zip(*(table.column(c) for c in ("rep", "t", "u", "factor", "place"))):
            rep, t, u = rep.as_py(), t.as_py(), u.as_py()
            if rep is not None:
                pairs.append((rep, t, u))
                continue
            v = np.frombuffer(held.as_buffer(), np.int32)
            if t is None:
                right[u] = v
            else:
                left.setdefault(t, []).append((factor.as_py(), v))
        out = []
        for rep, t, u in pairs:
            y = right[u]
            for factor, x in left.get(t, ()):
                both = np.flatnonzero((x >= 0) & (y >= 0))
                n = len(both)
                ic = None
                if n >= 2:
                    a, b = (np.empty(n) for _ in range(2))
                    for v, r in ((x, a), (y, b)):
                        mine = v[both]
                        seen = np.zeros(len(v), np.int32)
                        seen[mine] = 1
                        r[:] = np.cumsum(seen, dtype=np.int32)[mine] - (n + 1) / 2
                    ic = float(a @ b) / float(a @ a)
                out.append((factor, rep, ic))
        f, r, c = zip(*out) if out else ((), (), ())
        return pa.table({"factor": pa.array(f, pa.string()), "rep": pa.array(r, pa.int32()), "ic": pa.array(c, pa.float64())})

    met = asked.unionByName(values).unionByName(returns).repartition(PARTS, "p", "q").groupBy("p", "q").applyInArrow(correlate, "factor string, rep int, ic double")
    return met.groupBy("factor", "rep").agg(F.when(F.count("ic") >= 2, F.try_divide(F.avg("ic"), F.stddev_samp("ic"))).alias("ir")).where("ir is not null")


def alignment(irs: DataFrame, level: float = 0.01) -> DataFrame:
    """By factor of ``day_permutation``: the true value, the null's mean, deviation and quantiles, the true one's percentile and its p.

    p_upper and p_lower count the true order as one of the null; p_two is twice the lesser, 1 at most; p_align is the p
    of the side of the null's mean on which the true value lies, and ``aligned`` whether it is below ``level``.
    """
    real = irs.where("rep = -1").select("factor", F.col("ir").alias("observed"))
    null = irs.where("rep >= 0").join(real, "factor")
    q = F.percentile("ir", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    share = lambda c: (1.0 + F.sum(c.cast("int"))) / (F.count("*") + 1.0)
    x, o = F.col("ir"), F.col("observed")
    g = null.groupBy("factor", "observed").agg(
        F.count("*").alias("reps"), F.avg(x).alias("null_mean"), F.stddev_samp(x).alias("null_std"), q.alias("q"), F.avg((x < o).cast("double")).alias("below"), share(x >= o).alias("p_upper"), share(x <= o).alias("p_lower"),
    )
    p = F.when(F.col("observed") >= F.col("null_mean"), F.col("p_upper")).otherwise(F.col("p_lower"))
    return g.select(
        "factor", "observed", "reps", "null_mean", "null_std", *[F.col("q")[i].alias(k) for i, k in enumerate(("null_q5", "null_q50", "null_q95"))], (100 * F.col("below")).alias("percentile"),
        "p_upper", "p_lower", F.least(F.lit(1.0), 2 * F.least("p_upper", "p_lower")).alias("p_two"), p.alias("p_align"), (p < level).alias("aligned"),
    )


def ordinal_ic(valid: DataFrame) -> DataFrame:
    """Rows (factor, t, ic) from ordinal ranks, ties by name, of days with two names at least."""
    w = Window.partitionBy("factor", "t")
    r = lambda c: F.row_number().over(w.orderBy(c, "symbol")).cast("double")
    d = valid.withColumn("a", r("f")).withColumn("b", r("fwd"))
    return d.groupBy("factor", "t").agg(correlation(F.col("a"), F.col("b")).alias("ic"), F.count("*").alias("n")).where("n >= 2 and ic is not null").select("factor", "t", "ic")


def top_k_block(valid: DataFrame, k_frac: float = 0.2) -> DataFrame:
    """Rows (factor, t, k, spread, tail_ic, turn): best k over the pool, rank correlation within the best k (4 at least), names changed since the last day."""
    w = Window.partitionBy("factor", "t")
    d = pooled(valid).withColumn("k", F.greatest(F.lit(1), F.bround(F.col("n") * k_frac).cast("int"))).withColumn("rn", F.row_number().over(w.orderBy(F.desc("f"), F.desc("symbol"))))
    d = d.withColumn("in", F.col("rn") <= F.col("k"))
    top = F.when(F.col("in"), F.lit(1))
    r = lambda c: average_rank(F.col(c), "factor", "t", "in")
    d = d.withColumn("a", F.when(F.col("in"), r("f"))).withColumn("b", F.when(F.col("in"), r("fwd")))
    day = d.groupBy("factor", "t", "k").agg((F.avg(top * F.col("fwd")) - F.avg("fwd")).alias("spread"), correlation(F.col("a"), F.col("b")).alias("tail_ic"), F.array_sort(F.collect_list(F.when(F.col("in"), F.col("symbol")))).alias("held"))
    prev = F.lag("held", 1).over(Window.partitionBy("factor").orderBy("t"))
    day = day.withColumn("prev", prev)
    turn = F.when(F.col("prev").isNull(), 1.0).otherwise((F.size(F.array_except("held", "prev")) + F.size(F.array_except("prev", "held"))) / (2.0 * F.col("k")))
    return day.select("factor", "t", "k", "spread", F.when(F.col("k") >= 4, F.col("tail_ic")).alias("tail_ic"), turn.alias("turn"), "held")


def tail_metrics(block: DataFrame, cost_bps: float = 10.0, least: int = 10) -> DataFrame:
    """By factor: spread_ir and its moments, mean tail IC, its correlation with the spread, costs; null under ``least`` days."""
    m, s = F.avg("spread"), F.stddev_samp("spread")
    net = F.col("spread") - 2 * F.col("turn") * cost_bps / 1e4
    d = block.withColumn("mu", F.avg("spread").over(Window.partitionBy("factor")))
    c = lambda p: F.avg(F.pow(F.col("spread") - F.col("mu"), F.lit(float(p))))
    g = d.groupBy("factor").agg(
        F.count("*").alias("n"), F.try_divide(m, s).alias("spread_ir"), F.avg("tail_ic").alias("tail_ic"), correlation(F.col("spread"), F.col("tail_ic")).alias("spread_ic_corr"),
        F.try_divide(c(3), F.pow(s, F.lit(3.0))).alias("g3"), F.try_divide(c(4), F.pow(s, F.lit(4.0))).alias("g4"), F.avg("turn").alias("turn"), F.try_divide(m * 1e4, 2 * F.avg("turn")).alias("break_even_bps"), F.try_divide(F.avg(net), F.stddev_samp(net)).alias("net_ir"),
    )
    return g.select("factor", "n", *[F.when(F.col("n") >= least, F.col(k)).alias(k) for k in g.columns if k not in ("factor", "n")])


def least_hashes(t: int, names: list[bytes], selections: list[np.ndarray], width: int) -> list[list[str]]:
    """For each selection (places in ``names``) the least MD5 of (position, t, name) by position; a name is hashed once for all selections."""
    keys = Keys(names)
    out: list[list[str]] = [[] for _ in selections]
    for i in range(width):
        hi, lo = keys.digests(f"{i}:{t}:".encode())
        for own, sig in zip(selections, out):
            h = hi[own]
            first = h.min()
            sig.append(f"{int(first):016x}{int(lo[own][h == first].min()):016x}")
    return out


def least_by_place(days: DataFrame, width: int) -> DataFrame:
    return days.groupBy("factor").agg(F.array(*[F.min(F.col("sig")[i]) for i in range(width)]).alias("sig"))


def selection_signature(block: DataFrame, width: int = 32) -> DataFrame:
    """Rows (factor, sig): by position the least MD5 of (position, t, name) over all selections. A day's names are hashed once for all factors."""

    def run(table: pa.Table) -> pa.Table:
        held = table.column("held").combine_chunks()
        flat = held.flatten().dictionary_encode()
        ends, at = np.append(0, np.cumsum(held.value_lengths().to_numpy())), flat.indices.to_numpy()
        some = [i for i in range(len(held)) if ends[i + 1] > ends[i]]
        sigs = least_hashes(table.column("t")[0].as_py(), [k.encode() for k in flat.dictionary.to_pylist()], [at[ends[i] : ends[i + 1]] for i in some], width)
        return pa.table({"factor": table.column("factor").take(some) if some else pa.array([], pa.string()), "sig": pa.array(sigs, pa.list_(pa.string()))})

    return least_by_place(by_day(block.select("factor", "t", "held"), run, "factor string, sig array<string>"), width)


def top_k_days(panel: DataFrame, factors: list[str], horizon: int, step: int, ok: Column, k_frac: float = 0.2, width: int = 0, least: int = MIN_POOL) -> DataFrame:
    """Rows (factor, t, k, spread, sig): what ``top_k_block`` tells of the panel's cells, each day in one task; with ``width`` also the day's part of the signature.

    The best k come by selection, not by sorting: all above the k-th value, and of its ties the last by symbol.
    """
    names = list(factors)

    def run(table: pa.Table) -> pa.Table:
        t, fwd, text = table.column("t")[0].as_py(), numbers(table, "fwd"), table.column("symbol")
        found, held = [], []
        for i, factor in enumerate(names):
            f = numbers(table, f"f{i}")
            there = np.flatnonzero(~np.isnan(f))
            n = len(there)
            if n < least:
                continue
            k = max(1, int(np.round(n * k_frac)))  # to even, as bround
            v = f[there]
            edge = np.partition(v, n - k)[n - k]
            top = there[v > edge]
            ties = there[v == edge]
            if len(top) + len(ties) > k:
                last = sorted(zip([x.encode() for x in text.take(ties).to_pylist()], ties.tolist()), reverse=True)[: k - len(top)]
                ties = np.array([at for _, at in last], np.int64)
            own = np.concatenate([top, ties])
            held.append(own)
            found.append((factor, k, float(fwd[own].mean() - fwd[there].mean())))
        sigs = least_hashes(t, [x.encode() for x in text.to_pylist()], held, width) if width and held else [None] * len(held)
        f, k, spread = zip(*found) if found else ((), (), ())
        kind = table.column("t").type
        return pa.table({"factor": pa.array(f, pa.string()), "t": pa.array([t] * len(found), kind), "k": pa.array(k, pa.int32()), "spread": pa.array(spread, pa.float64()), "sig": pa.array(sigs, pa.list_(pa.string()))})

    d = sampled_days(panel.withColumn("fwd", forward_return(horizon)), names, step, ok, "symbol")
    return by_day(d, run, f"factor string, t {dict(d.dtypes)['t']}, k int, spread double, sig array<string>")


def selection_pairs(block: DataFrame) -> DataFrame:
    """Rows (a, b, jaccard, signature) for factors a < b: the shared part of their selections, exactly and by signature. Pairs are of factors, found over shared picks."""
    picks = block.select("factor", "t", F.explode("held").alias("s"))
    sizes = picks.groupBy("factor").agg(F.count("*").alias("n"))
    sig = selection_signature(block)
    shared = picks.select(F.col("factor").alias("a"), "t", "s").join(picks.select(F.col("factor").alias("b"), "t", "s"), ["t", "s"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("m"))
    j = shared.join(sizes.select(F.col("factor").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("factor").alias("b"), F.col("n").alias("nb")), "b")
    j = j.join(sig.select(F.col("factor").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("factor").alias("b"), F.col("sig").alias("sb")), "b")
    jac = F.col("m") / (F.col("na") + F.col("nb") - F.col("m"))
    return j.select("a", "b", jac.alias("jaccard"), signature_similarity("sa", "sb").alias("signature"), (2 * jac / (1 + jac)).alias("overlap"))


def regime_days(panel: DataFrame, factors: list[str], regimes: DataFrame, horizon: int) -> DataFrame:
    """Rows (factor, t, ic, regime): ordinal rank IC of every day with 30 bars that moved, over ``summed_forward``, and the day's regime."""
    d = summed_forward(panel, horizon).where(plain_mask())
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("factor"), F.col(k).alias("f")) for k in factors]))
    cells = d.select("t", "symbol", "fwd", pairs.alias("p")).select("p.factor", "t", "symbol", "p.f", "fwd")
    return plain_rank_ic(cells).join(regimes.select("t", "regime"), "t")


def regime_ic(days: DataFrame, *by: str, least: int = 10) -> DataFrame:
    """Rows (factor, regime, mean, std, n) of ``regime_days``, null under ``least`` days."""
    g = days.groupBy("factor", *by, "regime").agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.count("*").alias("n"))
    return g.select("factor", *by, "regime", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("mean", "std")], "n")


def u_regime(stats: DataFrame, *by: str) -> DataFrame:
    """By factor: the spread of mean ICs between regimes in units of their joint standard error; null unless two regimes have a mean."""
    d = stats.groupBy("factor", *by).agg(F.max("mean").alias("hi"), F.min("mean").alias("lo"), F.sum(F.when(F.col("mean").isNotNull(), F.col("n"))).alias("n"), F.count("mean").alias("regimes"))
    return d.select("factor", *by, F.when(F.col("regimes") >= 2, (F.col("hi") - F.col("lo")) * F.sqrt("n")).alias("u"), "regimes")


def u_regime_gated(days: DataFrame, regimes: DataFrame, least_cos: float = 0.0, least_z: float = 2.0) -> DataFrame:
    """By factor: ``u_regime`` kept only if both halves of the calendar agree on it; rows (factor, u, gate, cos, z_a, z_b).

    Each half needs a mean for every regime of ``regimes``; the centred means must point one way (cosine above
    ``least_cos``) and spread in each half by ``least_z`` standard errors. Else u is 0; gate says what failed. Where u is
    null, so is the rest, and gate is "none". Halves divide the calendar of ``regimes``.
    """
    half = regimes.agg(F.expr("count(distinct t) div 2").alias("half"), F.countDistinct("regime").alias("kinds"))
    cut = days.crossJoin(F.broadcast(half)).withColumn("side", F.when(F.col("t") < F.col("half"), "a").otherwise("b"))  # one row
    stats = regime_ic(cut.select("factor", "t", "ic", "regime", "side"), "side")
    means = stats.groupBy("factor", "regime").pivot("side", ["a", "b"]).agg(F.max("mean").alias("m"), F.max("n").alias("n"))
    centre = Window.partitionBy("factor")
    means = means.withColumn("x", F.col("a_m") - F.avg("a_m").over(centre)).withColumn("y", F.col("b_m") - F.avg("b_m").over(centre))
    z = lambda k: (F.max(f"{k}_m") - F.min(f"{k}_m")) * F.sqrt(F.greatest(F.sum(f"{k}_n"), F.lit(1)))
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    g = means.groupBy("factor").agg(F.count("a_m").alias("ka"), F.count("b_m").alias("kb"), F.sum(F.col("x") * F.col("y")).alias("xy"), norm("x").alias("nx"), norm("y").alias("ny"), z("a").alias("z_a"), z("b").alias("z_b"))
    d = u_regime(regime_ic(days)).join(g, "factor", "left").crossJoin(F.broadcast(half))  # one row
    cos = F.try_divide(F.col("xy"), F.col("nx") * F.col("ny"))
    whole = F.coalesce((F.col("ka") == F.col("kinds")) & (F.col("kb") == F.col("kinds")) & (F.col("kinds") >= 2), F.lit(False))
    gate = (
        F.when(F.col("u").isNull(), "none").when(~whole, "too_few_days").when((F.col("nx") < 1e-12) | (F.col("ny") < 1e-12), "no_difference")
        .when(cos <= least_cos, "direction").when((F.col("z_a") < least_z) | (F.col("z_b") < least_z), "size").otherwise("passed")
    )
    d = d.withColumn("gate", gate)
    told = F.col("gate").isin("direction", "size", "passed")
    return d.select("factor", F.when(F.col("gate").isin("passed", "none"), F.col("u")).otherwise(0.0).alias("u"), "gate", F.when(told, cos).alias("cos"), F.when(told, F.col("z_a")).alias("z_a"), F.when(told, F.col("z_b")).alias("z_b"))


def beta_rolling(panel: DataFrame, window: int = 60, least: int = 30) -> DataFrame:
    """The panel with ``beta``: rolling mean-product covariance with the equal-weight market over its variance."""
    r = panel.withColumn("_r", F.try_divide(F.col("c"), F.lag("c", 1).over(Wt())) - 1).withColumn("_m", F.avg("_r").over(Window.partitionBy("t")))
    sums = {"_r": F.col("_r"), "_m": F.col("_m"), "_rm": F.col("_r") * F.col("_m"), "_mm": F.col("_m") * F.col("_m")}
    d = rolling.with_rolling(r.withColumns(sums), {(k, window, least, "avg") for k in sums})
    m = lambda k: F.col(rolling.name(k, window, least, "avg"))
    return d.withColumn("beta", F.try_divide(m("_rm") - m("_r") * m("_m"), m("_mm") - m("_m") * m("_m"))).select(*panel.columns, "beta")


def exposure(panel: DataFrame, factors: list[str], to: str, step: int, least: int = MIN_POOL) -> DataFrame:
    """Rows (factor, exposure, days): mean daily rank correlation of each factor with the column ``to``."""
    ic = valued_ic(panel.withColumns({"fwd": F.col(to), "date": F.lit(None).cast("date")}), factors, step, F.lit(True), least)
    return ic.groupBy("factor").agg(F.avg("ic").alias("exposure"), F.count("*").alias("days"))


def region_stability(ic: DataFrame, dev_end: str, sel_end: str, months: tuple[int, ...] = (-3, -2, -1, 1, 2, 3), spread: float = 0.5, least: int = 10) -> DataFrame:
    """By factor: the IC's mean over deviation before the region's end, and its range as that end moves by months; rows (factor, base, lo, hi, variants, rel_spread, verdict).

    An end that would reach ``sel_end`` is held a day before it; one that is not after the first day, or leaves fewer
    than ``least`` days, is no variant. Without variants the verdict is insufficient; it is sign_fragile if the base is
    missing or zero or any variant has another sign, else magnitude_fragile if the range is ``spread`` of the base or more, else stable.
    """
    ends = F.explode(F.array(*[F.lit(m) for m in (0, *months)]))
    d = ic.withColumn("first", F.min("date").over(Window.partitionBy("factor"))).withColumn("off", ends)
    limit, dev = F.lit(sel_end).cast("date"), F.lit(dev_end).cast("date")
    end = F.when(F.col("off") == 0, dev).when(F.add_months(dev, F.col("off")) >= limit, F.date_sub(limit, 1)).otherwise(F.add_months(dev, F.col("off")))
    g = d.withColumn("end", end).where((F.col("end") > F.col("first")) | (F.col("off") == 0)).groupBy("factor", "off").agg(
        F.count(F.when(F.col("date") < F.col("end"), 1)).alias("n"), F.avg(F.when(F.col("date") < F.col("end"), F.col("ic"))).alias("m"), F.stddev_samp(F.when(F.col("date") < F.col("end"), F.col("ic"))).alias("s")
    )
    g = g.withColumn("ir", F.when(F.col("s") > 0, F.col("m") / F.col("s"))).withColumn("moved", (F.col("off") != 0) & (F.col("n") >= least))
    moved = F.when(F.col("moved"), F.col("ir"))
    h = g.groupBy("factor").agg(F.max(F.when(F.col("off") == 0, F.col("ir"))).alias("base"), F.min(moved).alias("lo"), F.max(moved).alias("hi"), F.count(F.when(F.col("moved"), 1)).alias("variants"))
    rel = F.try_divide(F.col("hi") - F.col("lo"), F.abs("base"))
    same = F.coalesce((F.col("base") != 0) & (F.coalesce(F.signum("lo") == F.signum("base"), F.lit(True))) & (F.coalesce(F.signum("hi") == F.signum("base"), F.lit(True))), F.lit(False))
    verdict = F.when(F.col("variants") == 0, "insufficient").when(~same, "sign_fragile").when(rel >= spread, "magnitude_fragile").otherwise("stable")
    return h.select("factor", "base", "lo", "hi", "variants", rel.alias("rel_spread"), verdict.alias("verdict"))


def series_moments(ic: DataFrame) -> DataFrame:
    """By factor: ir, central third and fourth moments over powers of the sample deviation, n."""
    d = ic.withColumn("mu", F.avg("ic").over(Window.partitionBy("factor")))
    c, s = lambda p: F.avg(F.pow(F.col("ic") - F.col("mu"), F.lit(float(p)))), F.stddev_samp("ic")
    return d.groupBy("factor").agg(F.try_divide(F.avg("ic"), s).alias("sr"), F.try_divide(c(3), F.pow(s, F.lit(3.0))).alias("g3"), F.try_divide(c(4), F.pow(s, F.lit(4.0))).alias("g4"), F.count("*").alias("n"))


def deflated(moments: DataFrame, bar: float, alpha: float = 0.05) -> DataFrame:
    """t of |sr| over ``bar`` with allowance for the moments, whether its one-sided p is below alpha, and how much longer the series would have to be for 1.96."""
    t = deflated_t(F.col("sr"), F.col("n"), F.col("g3"), F.col("g4"), bar)
    return moments.select("factor", "sr", "g3", "g4", "n", t.alias("t"), (t > NormalDist().inv_cdf(1 - alpha)).alias("passes"), (F.try_divide(F.lit(1.96 * 1.96), F.col("sr") * F.col("sr")) / F.col("n")).alias("length_ratio"))


def carving(ic: DataFrame, least: int = 3) -> DataFrame:
    """By factor: exact two-sided binomial p of its years' signs; null under ``least`` years."""
    years = ic.groupBy("factor", F.year("date").alias("y")).agg(F.avg("ic").alias("m")).where("m <> 0")
    g = years.groupBy("factor").agg(F.count("*").alias("years"), F.count(F.when(F.col("m") > 0, 1)).alias("up"))
    ways = "aggregate(if(i = 0, array(), sequence(1, i)), 1D, (c, j) -> c * (years - j + 1) / j)"
    below = F.expr(f"aggregate(sequence(0, cast(least(up, years - up) as int)), 0D, (s, i) -> s + {ways})")
    return g.select("factor", "years", "up", F.when(F.col("years") >= least, F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), F.col("years")))).alias("p"))


def quantiles(ic: DataFrame) -> DataFrame:
    """By factor: quantiles of the IC series, mean absolute value, and the spread p90 - p10 in deviations of a normal one."""
    q = F.percentile("ic", F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)])).alias("q")
    d = ic.groupBy("factor").agg(q, F.max("ic").alias("most"), F.avg(F.abs("ic")).alias("mean_abs"))
    return d.select("factor", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90, 99))], "most", "mean_abs", ((F.col("q")[4] - F.col("q")[0]) / 2.5631).alias("pool_std"))


def aligned_pairs(ic: DataFrame, last: int) -> DataFrame:
    """Rows (a, b, corr, n) for factors a < b: covariance (over n) of the last common days, over their sample deviations."""
    p = ic.select(F.col("factor").alias("a"), "t", F.col("ic").alias("x")).join(ic.select(F.col("factor").alias("b"), "t", F.col("ic").alias("y")), "t").where("a < b")
    p = p.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("t")))).where(F.col("r") <= last)
    return p.groupBy("a", "b").agg(F.try_divide(F.covar_pop("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")).alias("corr"), F.count("*").alias("n"))


def bucket_corr(a: DataFrame, b: DataFrame) -> DataFrame:
    """By factor: correlation of two IC series of different length, the longer one averaged over as many buckets as the shorter has rows."""
    seq = lambda d: d.withColumn("i", F.row_number().over(Window.partitionBy("factor").orderBy("t")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("factor")))
    a, b = seq(a), seq(b)
    k = a.groupBy("factor").agg(F.max("n").alias("na")).join(b.groupBy("factor").agg(F.max("n").alias("nb")), "factor").select("factor", F.least("na", "nb").alias("k"))
    cut = lambda d, c: d.join(k, "factor").groupBy("factor", F.expr("((i + 1) * k - 1) div n").alias("g")).agg(F.avg("ic").alias(c))
    return cut(a, "x").join(cut(b, "y"), ["factor", "g"]).groupBy("factor").agg(correlation(F.col("x"), F.col("y")).alias("corr"), F.count("*").alias("buckets"))


def verdicts(stats: DataFrame, nulls: DataFrame, summary: DataFrame, exposures: DataFrame, moments: DataFrame, bar: float, alpha: float = 0.05) -> DataFrame:
    """By factor: red flags, warnings, whether the evaluation is accepted and why not, and the verdict.

    Flags: ir_too_high (size above 5), few_days_for_ir (above 2 on fewer than 40 days), net_too_high (above 200 % a year),
    under_the_bar (size below ``bar``, if that is positive). Warnings: deflated_p above ``alpha``, or no_p. The verdict is
    needs_review with flags, without z, or with a beta of 0.3 or more; fail for z under 3; else pass. Accepted is what has
    a z of 3 at least, no such beta (a missing one is none), 20 days and a p; ``refused`` names the first that fails.
    """
    d = stats.join(nulls.select("factor", "z"), "factor").join(summary.select("factor", "net_annual"), "factor", "left").join(exposures.select("factor", "exposure"), "factor", "left")
    d = d.join(moments.select("factor", "sr", "g3", "g4"), "factor", "left").withColumn("t", deflated_t(F.col("sr"), F.col("n"), F.col("g3"), F.col("g4"), bar))
    d = d.withColumn("p", F.when(F.col("t").isNotNull(), F.expr(normal.upper_p("t"))))
    flag = lambda c, name: F.when(c, F.lit(name))
    size = F.abs("ir")
    flags = F.concat_ws(",", flag(size > 5, "ir_too_high"), flag((size > 2) & (F.col("n") < 40), "few_days_for_ir"), flag(F.col("net_annual") > 200, "net_too_high"), flag((F.abs("sr") < bar) & F.lit(bar > 0), "under_the_bar"))
    warnings = F.when(F.col("p").isNull(), "no_p").when(F.col("p") > alpha, "deflated_p")
    beta = F.coalesce(F.abs("exposure") >= 0.3, F.lit(False))
    refused = F.when(F.col("z").isNull(), "no_z").when(F.abs("z") < 3, "z").when(beta, "beta").when(F.col("n") < 20, "days").when(F.col("p").isNull(), "no_p")
    verdict = F.when((flags != "") | F.col("z").isNull(), "needs_review").when(F.abs("z") < 3, "fail").when(beta, "needs_review").otherwise("pass")
    return d.select("factor", "ir", "n", "z", "net_annual", "exposure", "p", flags.alias("flags"), warnings.alias("warnings"), refused.alias("refused"), refused.isNull().alias("accepted"), verdict.alias("verdict"))


def placebo(valid: DataFrame, k_frac: float, draws: int, seed: int) -> DataFrame:
    """Rows (factor, rep, spread): mean top-k spread with a day's returns dealt anew among its names.

    Which k names come first in a random order is the same as which are best by a permuted factor. The order is of the
    day's names, so one day is one row for all factors: a name is hashed once for each draw, and only numbers leave the row.
    """
    k = F.greatest(F.lit(1), F.bround(F.col("n") * k_frac).cast("int"))
    names = pooled(valid).groupBy("t", "symbol").agg(F.collect_list(F.struct("factor", k.alias("k"), "fwd")).alias("held"))
    days = names.groupBy("t").agg(F.collect_list(F.struct("symbol", "held")).alias("c"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, c in zip(*batch.columns):
                held, keys = c.values.field("held"), [s.encode() for s in c.values.field("symbol").to_pylist()]
                cells, owner = held.flatten(), np.repeat(np.arange(len(keys)), held.value_lengths().to_numpy())
                factor, size, fwd = cells.field("factor").dictionary_encode(), cells.field("k").to_numpy(), cells.field("fwd").to_numpy()
                at = factor.indices.to_numpy()
                each = [(owner[at == i], fwd[at == i], size[at == i][0]) for i in range(len(factor.dictionary))]
                out = np.empty((draws, len(each)))
                place = np.empty(len(keys), np.int64)
                for rep in range(draws):
                    head = f"{seed}:{rep}:{t.as_py()}:".encode()
                    hashed = np.frombuffer(b"".join([md5(head + x).digest() for x in keys]), ">u8").reshape(-1, 2)
                    place[np.lexsort((hashed[:, 1], hashed[:, 0]))] = np.arange(len(keys))
                    for i, (own, r, n) in enumerate(each):
                        first = np.argpartition(place[own], n - 1)[:n]
                        out[rep, i] = r[first].sum() / n - r.mean()
                yield pa.RecordBatch.from_arrays([pa.array(factor.dictionary.to_pylist() * draws), pa.array(np.repeat(np.arange(draws, dtype=np.int32), len(each))), pa.array(out.ravel())], ["factor", "rep", "s"])

    return days.select("t", "c").mapInArrow(deal, "factor string, rep int, s double").groupBy("factor", "rep").agg(F.avg("s").alias("mean_ic"))


def leaks(panel: DataFrame, evaluate, factors: dict, inputs: list[str], cuts: list[int]) -> DataFrame:
    """Rows (factor, cut, checked, changed, lost): past values that differ, or go missing, once the inputs from ``cut`` on are missing. A causal factor has none."""
    base = evaluate(panel, factors).select("symbol", "t", *factors)
    out = None
    for cut in cuts:
        blind = panel.select(*[F.when(F.col("t") < cut, F.col(c)).alias(c) if c in inputs else c for c in panel.columns])
        later = evaluate(blind, factors).where(F.col("t") < cut).select("symbol", "t", *[F.col(f).alias(f"{f}_") for f in factors])
        d = base.where(F.col("t") < cut).join(later, ["symbol", "t"])
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("x"), F.col(f"{f}_").alias("y")) for f in factors]))
        d = d.select(pairs.alias("p")).select("p.*")
        far = F.abs(F.col("x") - F.col("y")) > 1e-9 + 1e-6 * F.abs("x")
        got = d.groupBy("factor").agg(F.lit(cut).alias("cut"), F.count("x").alias("checked"), F.count(F.when(far, 1)).alias("changed"), F.count(F.when(F.col("x").isNotNull() & F.col("y").isNull(), 1)).alias("lost"))
        out = got if out is None else out.unionByName(got)
    return out
