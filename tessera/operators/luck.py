"""How good the best of many correlated trials is by chance.

Trials have sketches, short series of daily ICs. Their correlations over the common tail are X Xt for the matrix X of
centred sketches of unit length, so X z with independent normal z has just these correlations: no matrix of trials by
trials is made, factorised or repaired, and the work is linear in the trials. z comes from a hash of (seed, place in
the tail, draw), so every task makes the same numbers, a lost task repeats them, and a trial more can only raise a maximum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_POINTS, DRAWS, SEED, RIDGE = 60, 20_000, 42, 1e-8
LONGEST = 2_048


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_normals(seed: int, streams: np.ndarray, first: int, last: int) -> np.ndarray:
    """Standard normal numbers by (stream, draw) for the draws [first, last): a function of its arguments only."""
    with np.errstate(over="ignore"):
        base = _mixed(np.asarray(streams, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        at = np.arange(first, last, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        one = _mixed(base[:, None] + at[None, :])
        two = _mixed(one ^ np.uint64(0x5851F42D4C957F2D))
    u, v = ((x >> np.uint64(11)).astype(np.float64) + 0.5 for x in (one, two))
    return np.sqrt(-2 * np.log(u / 2**53)) * np.cos(2 * np.pi * v / 2**53)


def unit_tails(trials: DataFrame, least: int = LEAST_POINTS) -> DataFrame:
    """``trials(key, sketch array<double>)`` with ``vec``: the sketch over the tail common to all of ``least`` points or more, centred, of length one.

    Null for shorter sketches, such with nulls or NaN and such that do not vary, over the whole or over the tail: they
    count as independent of all others.
    """
    total = lambda e: f"aggregate({e}, 0D, (s, v) -> s + v)"
    fit = F.expr(f"size(sketch) >= {least} and not exists(sketch, v -> v is null or isnan(v) or abs(v) = double('infinity')) and array_max(sketch) > array_min(sketch)")
    d = trials.withColumn("_fit", F.coalesce(fit, F.lit(False)))
    tail = d.where("_fit").agg(F.min(F.size("sketch"))).first()[0] or 0
    if tail > LONGEST:
        raise ValueError(f"sketches of {LONGEST} points at most are expected")
    d = d.withColumn("_tail", F.expr(f"if(_fit, slice(sketch, -{tail}, {tail}), null)") if tail else F.expr("cast(null as array<double>)"))
    d = d.withColumn("_c", F.expr(f"transform(array({total('_tail')} / size(_tail)), m -> transform(_tail, v -> v - m))[0]")).withColumn("_n", F.expr(f"sqrt({total('transform(_c, v -> v * v)')})"))
    return d.withColumn("vec", F.when(F.col("_n") > 0, F.expr("transform(_c, v -> v / _n)"))).drop("_fit", "_tail", "_c", "_n")


def draw_maxima(vectors: DataFrame, draws: int = DRAWS, seed: int = SEED, two_sided: bool = True) -> DataFrame:
    """Rows (draw, most): the largest X (|X| if two-sided) among ``vectors(key, vec)``, X normal with the vectors' inner products as covariances.

    A null vec is an independent standard normal. Tasks keep a maximum for each draw; the rest is a max by draw.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.full(draws, -np.inf)
        for batch in batches:
            streams, vecs = batch.columns[0].to_numpy(), batch.columns[1]
            alone = np.array([not v.is_valid for v in vecs])
            rows = [np.array(v.as_py()) for v in vecs if v.is_valid]
            x = np.stack(rows) if rows else None
            for a in range(0, draws, 1_000):
                b, found = min(draws, a + 1_000), []
                if x is not None:
                    found.append(x @ hashed_normals(seed, np.arange(x.shape[1]), a, b))
                if alone.any():
                    found.append(hashed_normals(seed + 1, streams[alone], a, b))
                for f in found:
                    most[a:b] = np.maximum(most[a:b], (np.abs(f) if two_sided else f).max(axis=0))
        if np.isfinite(most).any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(most)], ["draw", "most"])

    return vectors.select(F.xxhash64("key").alias("stream"), "vec").mapInArrow(run, "draw long, most double").groupBy("draw").agg(F.max("most").alias("most"))


def expected_maximum(maxima: DataFrame) -> DataFrame:
    """One row (bar, se, draws): the mean of the maxima and its standard error; bar 0 without trials."""
    return maxima.agg(F.coalesce(F.avg("most"), F.lit(0.0)).alias("bar"), (F.stddev_samp("most") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("draws"))


def family_p(maxima: DataFrame, scores: DataFrame) -> DataFrame:
    """``scores(key, z)`` with ``p_fw``: the share of draws whose maximum reaches z. Counted over the sorted maxima by ranges, not pair by pair."""
    levels = maxima.select("most").withColumn("upto", F.lit(0)).unionByName(scores.where("z is not null").select(F.col("z").alias("most"), F.lit(1).alias("upto")).distinct())
    steps = levels.groupBy("most").agg(F.sum(F.expr("1 - upto")).alias("n"), F.max("upto").alias("asked"))
    cut = steps.where("asked = 1").select(F.col("most").alias("z"))
    hits = maxima.join(F.broadcast(cut) if cut.count() <= 10_000 else cut, F.col("most") >= F.col("z")).groupBy("z").agg(F.count("*").alias("k"))
    n = maxima.count()
    return scores.join(hits, "z", "left").withColumn("p_fw", F.when(F.col("z").isNotNull() & F.lit(n > 0), F.coalesce("k", F.lit(0)) / F.lit(max(n, 1)))).drop("k")


def tail_gram(vectors: DataFrame) -> DataFrame:
    """Rows (i, j, g) of Xt X, by places of the tail: summed in tasks, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = None
        for batch in batches:
            if rows := [v.as_py() for v in batch.columns[0]]:
                x = np.array(rows)
                g = x.T @ x if g is None else g + x.T @ x
        if g is not None:
            i, j = np.indices(g.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(g.ravel())], ["i", "j", "g"])

    return vectors.where("vec is not null").select("vec").mapInArrow(run, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def spectral_count(vectors: DataFrame) -> DataFrame:
    """One row (trials, m_eff): the square of the sum of the correlation matrix's eigenvalues over the sum of their squares.

    Their sum is the number of trials; their squares sum up to the squared entries, which are those of Xt X and one for
    each independent trial.
    """
    squares = tail_gram(vectors).agg(F.coalesce(F.sum(F.col("g") * F.col("g")), F.lit(0.0)).alias("s"))
    counts = vectors.agg(F.count("*").alias("trials"), F.count(F.when(F.col("vec").isNull(), 1)).alias("alone"))
    both = counts.crossJoin(F.broadcast(squares))  # one row each
    return both.select("trials", F.try_divide(F.col("trials").cast("double") * F.col("trials"), F.col("s") + F.col("alone")).alias("m_eff"))


def residual_shares(vectors: DataFrame, ridge: float = RIDGE) -> DataFrame:
    """Rows (key, nu): the share of each trial's variance that the other trials do not explain, 1 for independent ones.

    1 / diag(R^-1) with ``ridge`` on R's diagonal: the inverse is of the tail's length only, which ``unit_tails`` bounds.
    """
    cells = tail_gram(vectors).collect()
    if not cells:
        return vectors.select("key", F.lit(1.0).alias("nu"))
    size = 1 + max(c.i for c in cells)
    g = np.zeros((size, size))
    for c in cells:
        g[c.i, c.j] = c.g
    w, v = np.linalg.eigh((g + g.T) / 2)
    w = np.clip(w, 0, None)
    scale = 1.0 / (w + ridge)  # the diagonal of the inverse is (1 - sum y^2 * scale) / ridge, y being x in the eigenvectors' basis

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vecs = batch.columns
            nu = np.ones(len(vecs))
            at = [i for i, x in enumerate(vecs) if x.is_valid]
            if at:
                y = np.array([vecs[i].as_py() for i in at]) @ v
                inverse = np.maximum(1.0, (1.0 - (y * y) @ scale) / ridge)
                nu[at] = 1.0 / inverse
            yield pa.RecordBatch.from_arrays([keys, pa.array(nu)], ["key", "nu"])

    return vectors.select("key", "vec").mapInArrow(run, f"key {dict(vectors.dtypes)['key']}, nu double")
