"""Families of linked trials: components, greedy families, strong subsets and admission against a library.

Links are found in blocks or buckets and come as edges; what is decided over them (components, who leads a family)
takes rounds of joins over tables written between them, so no graph is gathered in one place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import drop_written, written

LINEAGE = 0.25


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Rows (key, family) for each of ``nodes(key)``: the least key reached over ``edges(a, b)``.

    Each round gives a node the least family among its own and its neighbours', and then its family's family. Edges
    with a null end or ends that are no nodes are ignored. RuntimeError if ``rounds`` do not settle it.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    state = written(nodes.select("key").distinct().select("key", F.col("key").alias("family")), "families")
    for _ in range(rounds):
        near = both.join(state.select(F.col("key").alias("b"), "family"), "b").groupBy(F.col("a").alias("key")).agg(F.min("family").alias("near"))
        hooked = state.join(near, "key", "left").select("key", F.col("family").alias("was"), F.least("family", F.coalesce("near", "family")).alias("family"))
        hooked = written(hooked, "hooked")
        up = hooked.select(F.col("key").alias("family"), F.col("family").alias("up"))
        jumped = written(hooked.join(up, "family", "left").select("key", "was", F.least("family", F.coalesce("up", "family")).alias("family")), "families")
        moved = not jumped.where("family <> was").isEmpty()
        drop_written(state, hooked)
        state = jumped
        if not moved:
            drop_written(both)
            return state.select("key", "family")
    raise RuntimeError("families did not settle")


def signature_components(trials: DataFrame, least: float = LINEAGE) -> DataFrame:
    """Rows (key, family) of ``trials(key, sig array)``: trials are linked where a share ``least`` of their signatures' places agree.

    Exact: signatures of n places that agree in k = ceil(least * n) agree in one of any n - k + 1, so trials meet by the
    values of the first n - k + 1 places and are then compared whole. Large families fill the same buckets, so first
    each trial is compared with the least key of its buckets only; what that joins has one label, and of a bucket only
    the trials outside its largest label are compared with the others. Null signatures are families of their own. Keys
    must differ; signatures of one length are expected.
    """
    sized = trials.where("sig is not null")
    n = sized.agg(F.max(F.size("sig"))).first()[0] or 0
    need = max(1, int(np.ceil(least * n - 1e-9)))
    agree = F.expr("aggregate(zip_with(sig, other, (u, v) -> if(u = v, 1, 0)), 0, (s, v) -> s + v)") >= need
    filed = sized.select("key", "sig", F.posexplode(F.slice("sig", 1, max(1, n - need + 1))).alias("place", "value"))
    filed = written(filed, "filed")
    heads = filed.groupBy("place", "value").agg(F.min("key").alias("head"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = filed.join(heads, ["place", "value"]).where("key <> head").select("key", "sig", "head").dropDuplicates(["key", "head"])
    met = met.join(sized.select(F.col("key").alias("head"), F.col("sig").alias("other")), "head").where(agree)
    labels = written(components(trials, met.select(F.col("key").alias("a"), F.col("head").alias("b"))), "labels")
    sizes = labels.groupBy("family").agg(F.count("*").alias("size"))
    held = written(filed.join(labels.join(sizes, "family"), "key"), "held")
    main = held.groupBy("place", "value").agg(F.max(F.struct("size", "family")).alias("m"), F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo <> hi")
    mixed = held.join(main.select("place", "value", F.col("m.family").alias("main")), ["place", "value"])
    left = mixed.where("family <> main").select("place", "value", "family", "sig")
    right = mixed.select("place", "value", F.col("family").alias("b"), F.col("sig").alias("other"))
    across = left.join(right, ["place", "value"]).where((F.col("family") != F.col("b")) & agree).select(F.col("family").alias("a"), "b").distinct()
    roots = components(labels.select(F.col("family").alias("key")), across).withColumnRenamed("family", "root")
    out = written(labels.join(roots, labels.family == roots.key).select(labels.key, F.col("root").alias("family")), "roots")
    drop_written(filed, labels, held)
    return out.select("key", "family")


def sketch_links(trials: DataFrame, least: float, block: int = 256) -> DataFrame:
    """Rows (a, b, rho) for pairs a < b of ``trials(key, sketch)`` with \\|rho\\| >= least: Pearson over sketches of one length, a null one linked to nothing.

    Blocks of trials meet block by block, so a task holds two blocks; only linked pairs leave it.
    """
    total = "aggregate(sketch, 0D, (s, v) -> s + v)"
    d = trials.where("sketch is not null").select("key", F.expr(f"transform(array({total} / size(sketch)), m -> transform(sketch, v -> v - m))[0]").alias("c"))
    d = d.select("key", "c", F.expr("sqrt(aggregate(c, 0D, (s, v) -> s + v * v))").alias("n")).where("n > 0").select("key", F.expr("transform(c, v -> v / n)").alias("x"))
    blocks = max(1, -(-d.count() // block))
    kind = dict(trials.dtypes)["key"]
    d = d.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    one = d.withColumn("o", each).select(F.least("g", "o").alias("p"), F.greatest("g", "o").alias("q"), "g", "key", "x")

    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        p, q = frame["p"].iloc[0], frame["q"].iloc[0]
        left, right = frame[frame["g"] == p], frame[frame["g"] == q]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "rho": []})
        r = np.clip(np.stack(left["x"].to_list()) @ np.stack(right["x"].to_list()).T, -1, 1)
        i, j = np.nonzero(np.abs(r) >= least)
        a, b = left["key"].to_numpy()[i], right["key"].to_numpy()[j]
        keep = a < b if p == q else np.ones(len(a), bool)
        low, high = np.where(a < b, a, b), np.where(a < b, b, a)
        return pd.DataFrame({"a": low[keep], "b": high[keep], "rho": r[i, j][keep]})

    return one.groupBy("p", "q").applyInPandas(pairs, f"a {kind}, b {kind}, rho double")


def greedy_leaders(nodes: DataFrame, edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Rows (key, lead) of ``nodes(key, place)`` taken in order of place (then key): a node leads unless an earlier leader is linked to it; then ``lead`` is the first such.

    The same as going through the nodes one by one. A node is settled once all its earlier neighbours are: it leads if
    none of them does. Each round settles at least the first open node, and in random order some few rounds settle all.
    """
    order = F.struct("place", "key")
    ranked = nodes.select("key", order.alias("o"))
    linked = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    early = linked.join(ranked.select(F.col("key").alias("a"), F.col("o").alias("oa")), "a").join(ranked.select(F.col("key").alias("b"), F.col("o").alias("ob")), "b").where("ob < oa")
    early = written(early.select("a", "b", "ob"), "earlier")
    state = written(nodes.select("key", F.lit(None).cast("boolean").alias("leads")), "leads")
    for _ in range(rounds):
        seen = early.join(state.select(F.col("key").alias("b"), "leads"), "b").groupBy(F.col("a").alias("key")).agg(F.max(F.coalesce("leads", F.lit(False))).alias("led"), F.max(F.col("leads").isNull()).alias("open"))
        now = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.col("led"), False).when(~F.coalesce("open", F.lit(False)), True)
        nxt = written(state.join(seen, "key", "left").select("key", now.alias("leads")), "leads")
        drop_written(state)
        state = nxt
        if state.where("leads is null").isEmpty():
            break
    else:
        raise RuntimeError("leaders did not settle")
    firsts = early.join(state.where("leads").select(F.col("key").alias("b")), "b").groupBy(F.col("a").alias("key")).agg(F.min_by("b", "ob").alias("first"))
    return state.join(firsts, "key", "left").select("key", F.when(F.col("leads"), F.col("key")).otherwise(F.col("first")).alias("lead"))


def greedy_families(trials: DataFrame, least: float = 0.6) -> DataFrame:
    """Rows (key, lead, depth, size) of ``trials(key, ts, sketch)``: in order of time, a trial opens a family unless an earlier opener correlates with it in size ``least``.

    depth is the place in time within the family, from 1. A null ts comes first, ties go by key.
    """
    placed = trials.select("key", F.struct(F.col("ts").isNotNull().alias("known"), "ts").alias("place"), "sketch")
    led = greedy_leaders(placed, sketch_links(trials, least))
    d = led.join(trials.select("key", "ts"), "key")
    family = Window.partitionBy("lead")
    return d.select("key", "lead", F.row_number().over(family.orderBy(F.asc_nulls_first("ts"), "key")).alias("depth"), F.count("*").over(family).alias("size"))


def strong_subset(factors: DataFrame, correlations: DataFrame, most: float = 0.7) -> DataFrame:
    """Rows (factor, kept, same_as) of ``factors(factor, ir)``: by falling ir a factor is kept unless a kept one correlates with it in size ``most``; a null ir comes last."""
    placed = factors.select(F.col("factor").alias("key"), F.struct(F.col("ir").isNull().alias("unknown"), (-F.col("ir")).alias("ir")).alias("place"))
    links = correlations.where(F.abs("corr") >= most).select("a", "b")
    led = greedy_leaders(placed, links)
    return led.select(F.col("key").alias("factor"), (F.col("key") == F.col("lead")).alias("kept"), F.when(F.col("key") != F.col("lead"), F.col("lead")).alias("same_as"))


def admit(candidates: DataFrame, library: DataFrame, correlations: DataFrame, same: float = 0.7, copy: float = 0.99) -> DataFrame:
    """Rows (factor, admit, reason, corr_max, most_similar, corr_raw, most_similar_raw) of ``candidates(factor, ir)`` against ``library(factor, ir, active)``.

    ``correlations(a, b, corr)`` in either order. A candidate as close as ``copy`` to any of the library is a near copy;
    else only active ones count: none, or none as close as ``same``, is independent; closer, it enters if its ir is
    larger than that of the closest (stronger), else not (weaker; a missing ir is the least). Without active factors it
    is the first. Ties of closeness go by name.
    """
    pairs = correlations.select("a", "b", "corr").unionByName(correlations.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    near = candidates.select(F.col("factor").alias("a")).join(pairs, "a").join(library.select(F.col("factor").alias("b"), F.col("ir").alias("theirs"), "active"), "b").where("corr is not null")
    order = Window.partitionBy("a").orderBy(F.desc(F.abs("corr")), "b")
    raw = near.withColumn("r", F.row_number().over(order)).where("r = 1").select(F.col("a").alias("factor"), F.col("corr").alias("corr_raw"), F.col("b").alias("most_similar_raw"))
    live = near.where("active").withColumn("r", F.row_number().over(order)).where("r = 1").select(F.col("a").alias("factor"), F.col("corr").alias("corr_max"), F.col("b").alias("most_similar"), "theirs")
    any_active = library.where("active").agg((F.count("*") > 0).alias("some"))
    d = candidates.join(raw, "factor", "left").join(live, "factor", "left").crossJoin(F.broadcast(any_active))  # one row
    copied = F.coalesce(F.abs("corr_raw") >= copy, F.lit(False))
    far = F.col("corr_max").isNull() | (F.abs("corr_max") < same)
    stronger = F.coalesce(F.col("ir"), F.lit(float("-inf"))) > F.coalesce(F.col("theirs"), F.lit(float("-inf")))
    reason = F.when(copied, "near_copy").when(~F.col("some"), "first").when(far, "independent").when(stronger, "stronger").otherwise("weaker")
    shown = [F.when(~copied, F.col(c)).alias(c) for c in ("corr_max", "most_similar")]
    return d.withColumn("reason", reason).select("factor", F.col("reason").isin("first", "independent", "stronger").alias("admit"), "reason", *shown, "corr_raw", "most_similar_raw")
