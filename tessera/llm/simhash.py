"""SimHash fingerprints and near-duplicate components by multi-index hashing.

A fingerprint is cut into three segments of 21, 21 and 22 bits. Two fingerprints at distance 4 or less agree
within one bit on one of the first two segments or wholly on the third (else they differ in 2 + 2 + 1 = 5). So
each fingerprint is filed under its own segments, and probes the Hamming ball of radius 1 around the first two.
Of the two probes that would find one pair, only the one that sets a bit is made.

Hot buckets: a cloud of near copies fills the same few buckets, and its pairs grow with its square. Members of a
bucket that are close to the bucket's smallest fingerprint are linked to it first, and the components of those
star edges label the fingerprints. Then only fingerprints with different labels have to be compared: within a
bucket, those outside the label of the largest component against the rest. Every link between different
components is found, and links inside one change nothing. The last search for components is over labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import materialize
from .graph import connected_components

DISTANCE = 4
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))  # first bit, bits, radius


def fingerprint(text: str | None, words: int = 4) -> int:
    """Signed 64-bit SimHash: the majority of the XXH64 bits of the word shingles; zero for a text without words."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    last = ends[min(words, len(tokens)) - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at : min(at + 65536, n)].tolist(), last[at : at + 65536].tolist())), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """Rows ``(doc_id, fp)``. Null text counts as empty; other columns are ignored."""

    @pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fingerprint(t, words) for t in s], dtype="int64")

    return docs.select("doc_id", simhash("text").alias("fp"))


def _segment(at: int, bits: int) -> str:
    return f"(shiftrightunsigned(fp, {at}) & {(1 << bits) - 1}L)"


def link(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Components of distinct fingerprints ``(fp)`` linked at ``distance`` (4 at most) bits: a row ``(fp, root)`` for each."""
    if distance > 4:
        raise ValueError("the segments and radii here hold for a distance of 4 at most")
    own = fps.select("fp", F.explode(F.array(*[F.expr(f"{_segment(a, b)} | {k}L << 32") for k, (a, b, _) in enumerate(SEGMENTS)])).alias("key"))
    near = f"bit_count(fp ^ pivot) <= {distance}"
    stars = own.join(own.groupBy("key").agg(F.min("fp").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n"), "key").where(f"fp <> pivot and {near}")
    stars = materialize(stars.select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct(), "stars")
    labels = connected_components(stars)
    sizes = labels.groupBy("root").agg(F.count("*").alias("size"))
    labelled = fps.join(labels.join(sizes, "root"), fps.fp == labels.node, "left").select("fp", F.coalesce("root", "fp").alias("label"), F.coalesce("size", F.lit(1)).alias("size"))
    labelled = materialize(labelled, "labels")

    probes = "array_distinct(flatten(array(" + ",".join(
        f"array(named_struct('key', {_segment(a, b)} | {k}L << 32, 'filed', true))"
        + (f", transform(filter(sequence(0, {b - 1}), i -> (shiftrightunsigned(fp, {a} + i) & 1L) = 0), i -> named_struct('key', ({_segment(a, b)} | shiftleft(1L, i)) | {k}L << 32, 'filed', false))" if r else "")
        for k, (a, b, r) in enumerate(SEGMENTS)
    ) + ")))"
    rows = labelled.select("fp", "label", "size", F.explode(F.expr(probes)).alias("p")).select("fp", "label", "size", "p.key", "p.filed")
    main = F.struct("size", "label")
    buckets = rows.groupBy("key").agg(F.max(main).alias("main"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("filed").alias("filed_any"))
    buckets = buckets.where("lo <> hi and filed_any").select("key", F.col("main.label").alias("main"))
    mixed = rows.drop("size").join(buckets, "key")
    left = mixed.where("label <> main").select("key", F.col("fp").alias("fp"), F.col("label").alias("a"), F.col("filed").alias("filed"))
    right = mixed.select("key", F.col("fp").alias("pivot"), F.col("label").alias("b"), F.col("filed").alias("filed_b"))
    met = left.join(right, (left.key == right.key) & (F.col("a") != F.col("b")) & (F.col("filed") | F.col("filed_b")) & F.expr(near))
    across = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    roots = connected_components(across)  # over labels: what the star edges joined is one node here
    return labelled.join(roots, labelled.label == roots.node, "left").select("fp", F.coalesce("root", "label").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = DISTANCE) -> DataFrame:
    """Rows ``(doc_id, fp, component_id)``: component_id is the smallest doc_id that links reach, the document's own included.

    Null text counts as empty. Texts without words have fingerprint 0, which links like any other. A repeated
    doc_id gives a row each time. Equal fingerprints meet before any comparison, so exact copies cost nothing more.
    """
    fp = materialize(fingerprints(docs, words), "fp")
    firsts = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    joined = materialize(firsts.join(link(firsts.select("fp"), distance), "fp"), "roots")
    ids = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    of = joined.join(ids, "root").select("fp", "component_id")
    return fp.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, words: int = 4, distance: int = DISTANCE) -> DataFrame:
    """The documents without those that have a near copy with a smaller doc_id in their component; columns stay."""
    drop = near_duplicates(docs, words, distance).where("doc_id <> component_id").select("doc_id")
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of ``documents``."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
