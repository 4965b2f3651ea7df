"""The bar that the best of many correlated top-k trials has to pass, and what passes it.

Two trials that hold the same names have correlated spreads: with overlap w of their lists and a share c of the pool
held, rho = (w - c) / (1 - c), clipped to [0, 1]. Overlaps come from MinHash signatures. The matrix of such values is
no correlation matrix by itself; it is projected onto one, and the expected maximum of normal values with it is drawn
as in ``luck``. The matrix has a row and a column for each trial of a ledger. Up to MOST trials its rows are made in
tasks and its eigenvectors on the driver; beyond, the bar of independent trials stands, which is never lower.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normal
from . import luck
from .families import signature_components

MOST, ALPHA = 4_096, 0.0253


def overlap_rho(jaccard: Column, share: Column, slope: float = 1.0, ambient: float = 0.0) -> Column:
    """Correlation of spreads from the Jaccard similarity of lists: clip(slope * (w - c) / (1 - c) + ambient, 0, 1) with w = 2 J / (1 + J)."""
    j = F.greatest(F.lit(0.0), F.least(F.lit(1.0), jaccard))
    rho = slope * (2 * j / (1 + j) - share) / (1 - F.greatest(F.lit(0.0), F.least(F.lit(0.999), share))) + ambient
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), rho))


def project(r: np.ndarray) -> np.ndarray:
    """The nearest matrix without negative eigenvalues, scaled to a diagonal of ones."""
    w, v = np.linalg.eigh((r + r.T) / 2)
    p = (v * np.clip(w, 0, None)) @ v.T
    d = np.sqrt(np.clip(np.diag(p), 1e-12, None))
    p = p / d[:, None] / d[None, :]
    np.fill_diagonal(p, 1.0)
    return p


def overlap_rows(trials: DataFrame, slope: float = 1.0, ambient: float = 0.0) -> DataFrame:
    """Rows (key, row array<double>) of the matrix over ``trials(key, sig array, k_frac)`` in order of key; sqrt of both shares stands for c. MOST trials at most."""
    trials = trials.withColumn("sig", F.expr("transform(sig, v -> xxhash64(v))"))  # of any type
    known = trials.select("key", "sig", "k_frac").orderBy("key").limit(MOST + 1).collect()  # bounded by MOST
    if len(known) > MOST:
        raise ValueError(f"{MOST} trials at most")
    sigs, shares = np.array([r.sig for r in known], np.int64).reshape(len(known), -1), np.array([r.k_frac for r in known], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, own, share = batch.columns
            rows = []
            for s, c in zip(own.to_pylist(), share.to_pylist()):
                j = (np.array(s)[None, :] == sigs).mean(axis=1)
                both = np.sqrt(c * shares)
                rows.append(np.clip(slope * (2 * j / (1 + j) - both) / (1 - np.clip(both, 0, 0.999)) + ambient, 0, 1))
            yield pa.RecordBatch.from_arrays([keys, pa.array([list(r) for r in rows], pa.list_(pa.float64()))], ["key", "row"])

    return trials.select("key", "sig", "k_frac").mapInArrow(run, f"key {dict(trials.dtypes)['key']}, row array<double>")


def wall(trials: DataFrame, slope: float = 1.0, ambient: float = 0.0, draws: int = luck.DRAWS, seed: int = luck.SEED) -> DataFrame:
    """One row (trials, emax, iid, se): the one-sided expected maximum over ``trials(key, sig, k_frac)``, that of independent ones, and the first's standard error.

    Trials with a null signature are independent of all others. Without trials both are 0. Both are drawn from numbers
    of their own; emax above iid by more than the errors of both would be a fault of the matrix.
    """
    spark = trials.sparkSession
    n = trials.count()
    alone = trials.select("key", F.expr("cast(null as array<double>)").alias("vec"))
    iid = luck.expected_maximum(luck.draw_maxima(alone, draws, seed + 7, two_sided=False)).select(F.col("bar").alias("iid"))
    signed = trials.where("sig is not null")
    if n > MOST:
        maxima = luck.draw_maxima(alone, draws, seed, two_sided=False)
    elif signed.isEmpty():
        maxima = luck.draw_maxima(alone, draws, seed, two_sided=False)
    else:
        rows = overlap_rows(signed, slope, ambient).orderBy("key").collect()  # MOST * MOST numbers at most
        r = np.array([x.row for x in rows])
        np.fill_diagonal(r, 1.0)
        w, v = np.linalg.eigh(project(r))
        root = v * np.sqrt(np.clip(w, 1e-8, None))
        made = spark.createDataFrame([(x.key, list(map(float, a))) for x, a in zip(rows, root)], f"key {dict(trials.dtypes)['key']}, vec array<double>")
        maxima = luck.draw_maxima(made.unionByName(alone.join(signed.select("key"), "key", "left_anti")), draws, seed, two_sided=False)
    found = luck.expected_maximum(maxima).select(F.col("bar").alias("emax"), "se")
    return found.crossJoin(F.broadcast(iid)).select(F.lit(n).cast("long").alias("trials"), "emax", "iid", "se")  # one row each


def deflation(blocks: DataFrame, emax: Column, alpha: float = ALPHA, fixed: Column | None = None) -> DataFrame:
    """``blocks(spread_ir, n_days, s0_emp, g3, g4, n)`` with the bar that the spread's information ratio has to pass.

    s0 is ``s0_emp`` where positive, else 1 / sqrt(n_days); sr0 = emax * s0, or ``fixed`` where positive. With moments
    (n of 5 or more) t_adj = (spread_ir - sr0) * sqrt(n - 1) / sqrt(max(1 - g3 s + (g4 - 1) / 4 s^2, 1e-8)) has to reach
    the normal quantile z of 1 - alpha; without, spread_ir has to reach sr0 + z * s0. Under 10 days there is no bar: ok is
    false and the rest null. required is the spread_ir that would just pass, by bisection up to a range of 10 or
    twice the numbers at hand; null where it lies beyond.
    """
    z = NormalDist().inv_cdf(1 - alpha)
    d = blocks.withColumn("ok", F.coalesce(F.col("n_days") >= 10, F.lit(False)))
    d = d.withColumn("s0_source", F.when(F.col("s0_emp") > 0, "empirical").otherwise("analytic")).withColumn("s0", F.when(F.col("s0_emp") > 0, F.col("s0_emp")).otherwise(F.try_divide(F.lit(1.0), F.sqrt("n_days"))))
    own = emax * F.col("s0")
    d = d.withColumn("sr0", F.when(fixed > 0, fixed).otherwise(own) if fixed is not None else own)
    d = d.withColumn("corrected", F.coalesce(F.col("g3").isNotNull() & F.col("g4").isNotNull() & (F.col("n") >= 5), F.lit(False)))
    below = lambda s: f"greatest(1D - g3 * {s} + (g4 - 1D) / 4 * {s} * {s}, 1e-8D)"
    t = lambda s: f"(({s} - sr0) * sqrt(n - 1) / sqrt({below(s)}))"
    d = d.withColumn("t_adj", F.expr(f"if(corrected, {t('coalesce(spread_ir, 0D)')}, (spread_ir - sr0) * sqrt(greatest(n_days - 1, 1)))"))
    d = d.withColumn("pass_g3", F.coalesce(F.expr(f"if(corrected, t_adj >= {z!r}D, spread_ir >= sr0 + {z!r}D * s0)"), F.lit(False)))
    top = "greatest(10D, coalesce(spread_ir, 0D) * 2 + sr0 * 2 + 5D)"
    halved = f"aggregate(sequence(1, 60), struct(0D as lo, {top} as hi), (b, i) -> if({t('((b.lo + b.hi) / 2)')} >= {z!r}D, struct(b.lo as lo, (b.lo + b.hi) / 2 as hi), struct((b.lo + b.hi) / 2 as lo, b.hi as hi))).hi"
    required = f"case when not corrected then sr0 + {z!r}D * s0 when {t(top)} < {z!r}D then null when {t('0D')} >= {z!r}D then 0D else {halved} end"
    d = d.withColumn("required", F.expr(required))
    hidden = ("s0", "s0_source", "sr0", "corrected", "t_adj", "required")
    return d.select(*blocks.columns, "ok", *[F.when(F.col("ok"), F.col(c)).alias(c) for c in hidden], (F.col("ok") & F.col("pass_g3")).alias("pass_g3"))


def admission(blocks: DataFrame, ledger: DataFrame, draws: int = luck.DRAWS, alpha: float = ALPHA, net: bool = False) -> DataFrame:
    """Which of ``blocks`` enter on the tail track, judged against the trials of ``ledger(key, sig, k_frac)``.

    A block has key, spread_ir, g3, g4, n, n_days, s0_emp, placebo_z, placebo_gate (of a heavier placebo, preferred),
    noise_z, and net_ir, net_g3, net_g4, net_n, which are judged if ``net`` is asked for and present. In order: no
    value (no_value); placebo z below 3 or missing (placebo); no noise z (noise_unknown), one of 3 or more in size
    (noise); no bar (no_bar), bar not passed (deflation); else admitted. Rows: the block's key, basis, the z judged,
    n_eff (families of the ledger), trials, emax, sr0, t_adj, required, stop (null if admitted), admitted.
    """
    use = F.lit(net) & F.col("net_ir").isNotNull()
    d = blocks.withColumn("basis", F.when(use, "net").otherwise("legacy" if net else "gross"))
    d = d.select("key", "basis", "n_days", "s0_emp", "placebo_z", "placebo_gate", "noise_z", *[F.when(F.col("basis") == "net", F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("net_ir", "spread_ir"), ("net_g3", "g3"), ("net_g4", "g4"), ("net_n", "n"))])
    families = signature_components(ledger.select("key", "sig"))
    counted = families.agg(F.countDistinct("family").alias("n_eff"))
    side = wall(ledger, draws=draws).select("trials", "emax").crossJoin(F.broadcast(counted))  # one row each
    d = d.crossJoin(F.broadcast(side))
    d = deflation(d, F.col("emax"), alpha)
    z = F.coalesce("placebo_gate", "placebo_z")
    stop = (
        F.when(F.col("spread_ir").isNull(), "no_value").when(z.isNull() | (z < 3), "placebo").when(F.col("noise_z").isNull(), "noise_unknown")
        .when(F.abs("noise_z") >= 3, "noise").when(~F.col("ok"), "no_bar").when(~F.col("pass_g3"), "deflation")
    )
    return d.select("key", "basis", z.alias("placebo"), "n_eff", "trials", "emax", "sr0", "t_adj", "required", stop.alias("stop"), stop.isNull().alias("admitted"))


def counted_bar(families: DataFrame) -> DataFrame:
    """One row (n_eff, trials, emax): the older bar, the expected maximum of as many independent trials as there are families ``(key, family)``."""
    d = families.agg(F.countDistinct("family").alias("n_eff"), F.count("*").alias("trials"))
    return d.withColumn("emax", F.expr(normal.expected_maximum("n_eff")))
