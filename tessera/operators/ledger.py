"""Relational work over the trial ledger: summaries, families of linked trials, queues and reconciliation.

A trail has a row for each trial: id, ts, source_hash, horizon, stage, lane, verdict, ic_ir, spread_ir, n, g3, g4,
sketch (array<double>, a short IC series) and mh (array<long>, a MinHash signature). Newer means later ts, then larger id.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .families import components, greedy_families, signature_components

STAGES = ("development", "batch", "composite")


def newest_first(*by: str):
    return Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("id"))


def latest(trail: DataFrame, *by: str) -> DataFrame:
    """The newest row of each key."""
    return trail.withColumn("_rn", F.row_number().over(newest_first(*by))).where("_rn = 1").drop("_rn")


def sketch_corr(a: str, b: str) -> Column:
    """Pearson of two arrays of one length; null where one does not vary."""
    total = lambda e: f"aggregate({e}, 0D, (s, v) -> s + v)"
    n, sx, sy = f"size({a})", total(a), total(b)
    sxy, sxx, syy = (total(f"zip_with({p}, {q}, (u, v) -> u * v)") for p, q in ((a, b), (a, a), (b, b)))
    return F.expr(f"try_divide({n} * {sxy} - {sx} * {sy}, sqrt(greatest(0D, {n} * {sxx} - {sx} * {sx})) * sqrt(greatest(0D, {n} * {syy} - {sy} * {sy})))")


def signature_similarity(a: str, b: str) -> Column:
    """Share of equal positions of two signatures."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (u, v) -> if(u = v, 1D, 0D)), 0D, (s, v) -> s + v) / size({a})")


def trail_summary(trail: DataFrame) -> DataFrame:
    """By verdict: trials, different (source_hash, horizon), sources, newest ts."""
    return trail.groupBy("verdict").agg(F.count("*").alias("trials"), F.countDistinct("source_hash", "horizon").alias("pairs"), F.countDistinct("source_hash").alias("sources"), F.max("ts").alias("newest"))


def registry_view(trail: DataFrame, ic_bar: float = 0.5, tail_bar: float = 0.75) -> DataFrame:
    """By horizon: sources admitted on the IC track, the tail track, and both, judged on their latest trial."""
    d = latest(trail, "source_hash", "horizon").select("horizon", F.coalesce(F.abs("ic_ir") >= ic_bar, F.lit(False)).alias("i"), F.coalesce(F.col("spread_ir") >= tail_bar, F.lit(False)).alias("s"))
    count = lambda c: F.count(F.when(c, 1))
    i, s = F.col("i"), F.col("s")
    return d.groupBy("horizon").agg(count(i & ~s).alias("ic_only"), count(s & ~i).alias("tail_only"), count(i & s).alias("dual"), F.count("*").alias("all"))


def explored(preset: DataFrame, entries: DataFrame, query: str, k: int) -> DataFrame:
    """The k names of preset and entries ``(name)`` that hold most of the query's words, ties by name."""
    words = F.array(*[F.lit(w) for w in query.lower().split()])
    both = preset.select("name", F.lit("preset").alias("origin")).unionByName(entries.select("name", F.lit("trial").alias("origin"))).distinct()
    score = F.size(F.array_intersect(F.split(F.lower("name"), "[^a-z0-9]+"), words))
    return both.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "name", "origin").limit(k)


def family_chain(trail: DataFrame, by: str = "lane", rho: float = 0.6, share: float = 0.25) -> DataFrame:
    """For each ``by``: the run of trials, from the newest backwards, that are linked to the newest by |corr| or signature; ``rn`` counts back."""
    d = trail.withColumn("rn", F.row_number().over(newest_first(by)))
    head = d.where("rn = 1").select(by, F.col("sketch").alias("_s"), F.col("mh").alias("_m"))
    d = d.join(head, by)
    linked = F.coalesce(F.abs(sketch_corr("sketch", "_s")) >= rho, F.lit(False)) | (signature_similarity("mh", "_m") >= share)
    first_break = F.min(F.when((F.col("rn") > 1) & ~linked, F.col("rn"))).over(Window.partitionBy(by))
    return d.withColumn("_b", first_break).where("_b is null or rn < _b").drop("_b", "_s", "_m")


def family_marginal(chain: DataFrame, by: str = "lane") -> DataFrame:
    """Best |ic_ir| of the last W = clip(n div 2, 5, 10) trials minus the best before, and trials since the best; null below what W needs."""
    d = chain.where("ic_ir is not null").withColumn("a", F.abs("ic_ir")).withColumn("r", F.row_number().over(newest_first(by)))
    d = d.withColumn("n", F.count("*").over(Window.partitionBy(by))).withColumn("best", F.max("a").over(Window.partitionBy(by)))
    d = d.withColumn("w", F.expr("greatest(5, least(10, n div 2))"))
    g = d.groupBy(by).agg(F.count("*").alias("family"), F.max("best").alias("best"), F.max(F.when(F.col("r") <= F.col("w"), F.col("a"))).alias("recent"), F.max(F.when(F.col("r") > F.col("w"), F.col("a"))).alias("before"), (F.min(F.when(F.col("a") >= F.col("best") - 1e-9, F.col("r"))) - 1).cast("long").alias("plateau"))
    enough = (F.col("family") >= 5) & F.col("before").isNotNull()
    return g.select(by, "family", enough.alias("enough"), *[F.when(enough, F.col(c)).alias(c) for c in ("best", "recent", "before", "plateau")], F.when(enough, F.col("recent") - F.col("before")).alias("marginal"))


def family_convergence(chain: DataFrame, by: str = "lane", window: int = 5, delta: float = 0.02, delta_tail: float = 0.02) -> DataFrame:
    """Whether neither line's best of the last ``window`` different (source_hash, horizon) beats the window before by delta.

    A key stands where it was first tried and counts with its latest value. Too few tail values leave the IC line alone to decide.
    """
    key = chain.groupBy(by, "source_hash", "horizon").agg(
        F.max("rn").alias("pos"), F.max_by(F.abs("ic_ir"), F.when(F.col("ic_ir").isNotNull(), -F.col("rn"))).alias("ic"), F.max_by("spread_ir", F.when(F.col("spread_ir").isNotNull(), -F.col("rn"))).alias("sp")
    )
    out = None
    for name in ("ic", "sp"):
        r = F.row_number().over(Window.partitionBy(by).orderBy("pos"))
        best = lambda lo, hi, n=name: F.max(F.when((F.col("r") > lo) & (F.col("r") <= hi), F.col(n)))
        one = key.where(f"{name} is not null").withColumn("r", r).groupBy(by).agg(F.count("*").alias(f"{name}_n"), best(0, window).alias(f"{name}_recent"), best(window, 2 * window).alias(f"{name}_before"))
        out = one if out is None else out.join(one, by, "left")
    flat = F.coalesce((F.col("ic_n") >= 2 * window) & (F.col("ic_recent") - F.col("ic_before") < delta), F.lit(False))
    tail_moves = F.coalesce((F.col("sp_n") >= 2 * window) & (F.col("sp_recent") - F.col("sp_before") >= delta_tail), F.lit(False))
    return out.withColumn("sp_n", F.coalesce("sp_n", F.lit(0).cast("long"))).withColumn("converged", flat & ~tail_moves)


def deflated_t(sr: Column, n: Column, g3: Column, g4: Column, bar: float) -> Column:
    """How far |sr| stands above ``bar`` in standard errors that allow for skewness and kurtosis; null under 5 values."""
    return F.when(n >= 5, (F.abs(sr) - bar) * F.sqrt(n - 1) / F.sqrt(F.greatest(F.lit(1e-8), 1 - g3 * sr + (g4 - 1) / 4 * sr * sr)))


def near_miss_queue(trail: DataFrame, bar: float, least: float = 0.75, p: tuple[float, float] = (0.05, 0.30)) -> DataFrame:
    """Latest trials of strong sources that are not admitted and whose one-sided p lies in (p[0], p[1]], with how many later trials of their lane tried a variant.

    p falls with t, so the bounds are set on t. Variants are the lane's later trials less the source's own: two running counts, no pairs.
    """
    hi, lo = (NormalDist().inv_cdf(1 - x) for x in p)
    later = lambda *by: F.count("*").over(Window.partitionBy(*by)) - F.count("*").over(Window.partitionBy(*by).orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counted = trail.withColumn("variants", later("lane") - later("lane", "source_hash"))
    last = latest(counted, "source_hash", "horizon").where(F.abs("spread_ir") >= least).withColumn("t", deflated_t(F.col("spread_ir"), F.col("n"), F.col("g3"), F.col("g4"), bar))
    open_ = last.where((F.col("t") >= lo) & (F.col("t") < hi)).join(trail.where("verdict = 'pass'").select("source_hash").distinct(), "source_hash", "left_anti")
    return open_.select("id", "source_hash", "horizon", "t", "variants")


def representative(trail: DataFrame) -> DataFrame:
    """By source: the latest trial with an ic_ir, and when and with what verdict the source was first seen."""
    order = F.struct("ts", "id")
    ok = F.when(F.col("ic_ir").isNotNull(), order)
    return trail.groupBy("source_hash").agg(F.max_by("id", ok).alias("id"), F.max_by("ic_ir", ok).alias("ic_ir"), F.min("ts").alias("first_seen"), F.min_by("verdict", order).alias("first_verdict"))


def graph_families(nodes: DataFrame) -> DataFrame:
    """Rows (id, family, size, depth) of ``nodes(id, parent, ts)``: families are what parent links join, in either direction.

    A parent that is no node joins its children but is no member. depth is the place in time within the family, ties by
    id; family is the least id reached, absent parents included. Cycles are families like others.
    """
    known = nodes.where("id is not null").select("id", "parent", "ts")
    ids = known.select(F.col("id").alias("key")).unionByName(known.where("parent is not null").select(F.col("parent").alias("key"))).distinct()
    found = components(ids, known.where("parent is not null").select(F.col("id").alias("a"), F.col("parent").alias("b")))
    d = known.join(found, known.id == found.key)
    of = Window.partitionBy("family")
    return d.select("id", "family", F.count("*").over(of).alias("size"), F.row_number().over(of.orderBy("ts", "id")).alias("depth"))


def frontier(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """Sources of ``nodes(source_hash, status)`` with no status or status frontier, and those of ``near`` that are not among them."""
    waiting = nodes.where("status is null or status = 'frontier'").select("source_hash")
    return waiting.unionByName(near.select("source_hash")).where("source_hash is not null").distinct()


def rescue_cards(trail: DataFrame, admitted: DataFrame, journal: DataFrame) -> DataFrame:
    """A card for each source's representative, with the first rule that stops it as its status."""
    cards = representative(trail).join(admitted.select("source_hash", F.lit(True).alias("in")), "source_hash", "left").join(journal.groupBy("source_hash").agg(F.count("*").alias("tries")), "source_hash", "left")
    tries = F.coalesce("tries", F.lit(0).cast("long"))
    status = F.when(F.col("in"), "admitted").when(F.col("ic_ir").isNull(), "no_result").when(tries >= 120, "exhausted").when(F.abs("ic_ir") < 0.25, "too_weak").otherwise("open")
    return cards.select("source_hash", "id", "ic_ir", tries.alias("tries"), status.alias("status"))


def card_families(cards: DataFrame, least: float = 0.6) -> DataFrame:
    """Rows (key, representative, members) of ``cards(key, p, sketch)``: greedy families of sketches, in order of key; the member of the smallest p (none comes last, then key) stands for its family.

    Cards with a sketch of fewer than five points are families of their own.
    """
    d = cards.select("key", "p", F.when(F.size("sketch") >= 5, F.col("sketch")).alias("sketch"))
    fam = greedy_families(d.select("key", F.lit(0).alias("ts"), "sketch"), least).select("key", "lead")
    j = d.select("key", "p").join(fam, "key")
    heads = j.groupBy("lead").agg(F.min_by("key", F.struct(F.col("p").isNull(), "p", "key")).alias("representative"), F.count("*").alias("members"))
    return j.join(heads, "lead").select("key", "representative", "members")


def follow_rate(heads: DataFrame, expands: DataFrame, hours: int = 48) -> DataFrame:
    """How many heads ``(id, ts, key)`` are followed by an expand ``(ts, key)`` of their key within so many hours: an interval join."""
    e = expands.select(F.col("key").alias("_k"), F.col("ts").alias("_t"))
    hit = heads.join(e, (F.col("key") == F.col("_k")) & (F.col("_t") >= F.col("ts")) & (F.col("_t") <= F.col("ts") + F.expr(f"interval {hours} hours")), "left_semi")
    n = heads.agg(F.count("*").alias("total"))
    return hit.agg(F.count("*").alias("followed")).crossJoin(n).withColumn("rate", F.try_divide("followed", "total"))


def reconcile(scores: DataFrame, expands: DataFrame) -> DataFrame:
    """Parents' latest score against the gain of what followed it, by quintile of the score: rows (bucket, n, score, gain) and the rank correlation of all."""
    last = scores.groupBy("key").agg(F.max_by(F.struct("score", F.col("ts").alias("at")), F.struct("ts", "score")).alias("s")).select("key", "s.*")
    d = expands.where("gain is not null").join(last, "key").where("at <= ts").select("score", "gain")
    every = Window.partitionBy(F.lit(1))  # pairs of one report, not of the panel
    r = lambda c: F.rank().over(every.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0
    d = d.withColumn("i", F.row_number().over(every.orderBy("score", "gain")) - 1).withColumn("k", F.count("*").over(every)).withColumn("rs", r("score")).withColumn("rg", r("gain"))
    d = d.withColumn("rho", F.corr("rs", "rg").over(every)).withColumn("bucket", F.expr("cast(least(4, (i * 5) div k) as int)"))
    return d.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.avg("gain").alias("gain"), F.max("rho").alias("rho"))


def tail_telemetry(trail: DataFrame, bar: float) -> DataFrame:
    """By horizon over latest trials with a tail value: their number, families of selections, the upper median of their periods, best value, and near misses within 0.10 under the bar."""
    d = latest(trail, "source_hash", "horizon").where("spread_ir is not null")
    of = Window.partitionBy("horizon")
    d = d.withColumn("r", F.row_number().over(of.orderBy("n"))).withColumn("k", F.count("*").over(of))
    near = F.count(F.when((F.col("spread_ir") >= bar - 0.10) & (F.col("spread_ir") < bar), 1))
    got = d.groupBy("horizon").agg(F.count("*").alias("entries"), F.max(F.when(F.col("r") == F.expr("k div 2 + 1"), F.col("n"))).alias("periods"), F.max("spread_ir").alias("best"), near.alias("near_misses"))
    # Values of different horizons never agree, so one search serves all.
    sig = F.expr("transform(mh, v -> xxhash64(horizon, v))")
    fam = signature_components(d.select(F.col("id").alias("key"), sig.alias("sig")))
    n_eff = fam.join(d.select(F.col("id").alias("key"), "horizon"), "key").groupBy("horizon").agg(F.countDistinct("family").alias("n_eff"))
    return got.join(n_eff, "horizon").select("horizon", "entries", "n_eff", "periods", "best", "near_misses")


def tail_ledger(trail: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """The newest trial by (source_hash, horizon, k_frac, cost model) of the given stages that has a spread_ir; a null cost model is "legacy"."""
    d = trail.where(F.col("stage").isin(*stages) & F.col("spread_ir").isNotNull()).withColumn("cost_model", F.coalesce("cost_model", F.lit("legacy")))
    return latest(d, "source_hash", "horizon", "k_frac", "cost_model")


def near_misses(ledger: DataFrame, bar: float, k: int = 3) -> DataFrame:
    """The k newest that miss the bar by 0.10 at most."""
    return ledger.where((F.col("spread_ir") >= bar - 0.10) & (F.col("spread_ir") < bar)).orderBy(F.desc("ts"), F.desc("id")).limit(k)


def coverage(trail: DataFrame) -> DataFrame:
    """Trials by (lane, horizon), the newest, the best, and an exhaustion tier by their number."""
    g = trail.groupBy("lane", "horizon").agg(F.count("*").alias("trials"), F.max("ts").alias("newest"), F.max(F.abs("ic_ir")).alias("best"))
    return g.withColumn("tier", F.when(F.col("trials") >= 800, "exhausted").when(F.col("trials") >= 400, "worn").otherwise("fresh"))


def exhaustion(trail: DataFrame, now, by: str = "lane", sample: int = 20, inside: tuple[float, float] = (0.4, 0.6), outside: float = 0.5, dense: int = 10, days: float = 14.0) -> DataFrame:
    """Rows (by, trials, intra, inter, age, tier): how used up each bin is.

    intra and inter are mean sizes of correlations between sketches of five points or more, within a bin and with trials
    of other bins, over ``sample`` trials of each side in the order of a hash (sampling is the feature: bins are read,
    not searched); null under three pairs. A bin is exhausted if intra reaches inside[1], fading if inside[0];
    else, from three trials on, an inter of ``outside`` makes it exhausted if it has ``dense`` trials, fading if fewer;
    else fading if dense and without a trial for ``days``; else fresh.
    """
    d = trail.select(F.col(by).alias("bin"), "id", "ts", "sketch").where("bin is not null")
    g = d.groupBy("bin").agg(F.count("*").alias("trials"), ((F.lit(now).cast("timestamp").cast("double") - F.max("ts").cast("timestamp").cast("double")) / 86400).alias("age"))
    dice = F.md5(F.col("id").cast("string"))
    own = d.withColumn("r", F.row_number().over(Window.partitionBy("bin").orderBy(dice, "id"))).where(F.col("r") <= sample).where(F.size("sketch") >= 5)
    # Whoever is among the first of all other bins is among the first of its own bin and of all: a few rows for each bin suffice.
    heads = d.withColumn("r", F.row_number().over(Window.partitionBy("bin").orderBy(dice, "id"))).where(F.col("r") <= sample)
    bins = g.select(F.col("bin").alias("b"))
    others = heads.select(F.col("bin").alias("o"), "id", "sketch").join(bins, F.col("o") != F.col("b"))
    others = others.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(dice, "id"))).where(F.col("r") <= sample).where(F.size("sketch") >= 5)
    pairs = own.select("bin", F.col("id").alias("i"), F.col("sketch").alias("x"))
    mean = lambda j, name: j.withColumn("c", F.abs(sketch_corr("x", "y"))).groupBy("bin").agg(F.when(F.count("c") >= 3, F.avg("c")).alias(name))
    intra = mean(pairs.join(own.select("bin", F.col("id").alias("k"), F.col("sketch").alias("y")), "bin").where("i < k"), "intra")
    inter = mean(pairs.join(others.select(F.col("b").alias("bin"), F.col("sketch").alias("y")), "bin"), "inter")
    h = g.join(intra, "bin", "left").join(inter, "bin", "left")
    tier = (
        F.when((F.col("trials") >= 2) & (F.col("intra") >= inside[1]), "exhausted").when((F.col("trials") >= 2) & (F.col("intra") >= inside[0]), "fading")
        .when((F.col("trials") >= 3) & (F.col("inter") >= outside), F.when(F.col("trials") >= dense, "exhausted").otherwise("fading"))
        .when((F.col("trials") >= dense) & (F.col("age") > days), "fading").otherwise("fresh")
    )
    return h.select(F.col("bin").alias(by), "trials", "intra", "inter", "age", tier.alias("tier"))


def selection_budget(spends: DataFrame, cap: int = 60, alpha: float = 0.05) -> DataFrame:
    """Of a ledger of looks ``spends(band)``: by data band how many are spent, what remains of ``cap``, whether the band is sealed, each look's level and the level spent."""
    g = spends.where("band is not null").groupBy("band").agg(F.count("*").alias("spent"))
    weight = F.lit(alpha / cap)
    return g.select("band", "spent", F.greatest(F.lit(0).cast("long"), cap - F.col("spent")).alias("remaining"), (F.col("spent") >= cap).alias("sealed"), weight.alias("alpha_weight"), (F.col("spent") * weight).alias("alpha_spent"))
