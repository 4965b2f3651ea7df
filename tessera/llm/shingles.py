"""Near copies by the Jaccard similarity of word shingles: SimHash and min-hash bands find candidates, the shingle sets decide.

A text is the set of its five-word shingles. The sets' SimHashes are searched by multi-index hashing with Hamming balls, as
``simhash`` does, at 4 bits; each document of a component found so is compared with its first one. Sets of similarity 0.8
differ in 10 of 64 bits on average, which no ball of that size reaches, so bands find the rest: 80 min-hashes in 20 bands of 4 file it under 20 keys: two sets of similarity
0.8 share none of them with probability (1 - 0.8 ** 4) ** 20 = 2.6e-5, and less above. Every candidate pair is verified
by its exact similarity, so nothing is linked below 0.8.

Hot buckets are searched as in ``simhash``: members are compared with the bucket's first document, the links found label
the documents, and then only documents with different labels have to be compared. Variants of one text, too far from each
other to be linked, share most buckets all the same; which of them can be linked is found by their rare shingles (``_meeting``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import simhash
from .common import give_back, materialize, release, small_batches
from .graph import connected_components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
BROADCAST = 500_000  # identifiers sent to all executors at most; more are joined by a shuffle, with the same rows
_rng = np.random.default_rng(42)
_A = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64)[:, None]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; fewer words than ``words`` are one shingle, none give an empty set."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    last = ends[min(words, len(tokens)) - 1 :]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), last.tolist())), np.uint64))


def bands(s: np.ndarray) -> np.ndarray:
    """The keys of a shingle set, one for each band; an empty set has none."""
    if not len(s):
        return np.empty(0, np.int64)
    low = np.min([(s[at : at + 4096] * _A + _B).min(axis=1) for at in range(0, len(s), 4096)], axis=0)
    return np.array([xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) - 2**63 for k in range(BANDS)], np.int64)


def sketch(s: np.ndarray) -> int:
    """The signed 64-bit SimHash of a shingle set: the majority of the bits; zero for an empty set."""
    ones = sum((np.unpackbits(s[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for at in range(0, len(s), 65536)), np.zeros(64, np.int64))
    return int(np.packbits(ones * 2 > len(s), bitorder="little").view(np.int64)[0])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _filed(docs: DataFrame, words: int) -> DataFrame:
    """Rows ``(doc_id, digest, n, fp, keys)``: a digest of the shingle set, its size, its SimHash, its bands' keys."""

    @pandas_udf("struct<digest:string,n:long,fp:long,keys:array<long>>")
    def file(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        for texts in batches:
            rows = [(xxhash.xxh3_128_hexdigest(s.tobytes()), len(s), sketch(s), bands(s)) for s in (shingles(t, words) for t in texts)]  # one set at a time
            yield pd.DataFrame(rows, columns=["digest", "n", "fp", "keys"])
        give_back()

    return docs.select("doc_id", file("text").alias("x")).select("doc_id", "x.*")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs ``(a, b)`` of documents whose sets have a similarity of ``least`` or more."""

    @pandas_udf("double")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = lru_cache(32)(lambda t: shingles(t, words))  # a hot document comes many times in a row
        for a, b in batches:
            yield pd.Series([similarity(shingles(x, words), known(y)) for x, y in zip(a, b)], dtype="float64")
        give_back()

    pairs = materialize(pairs, "pairs")
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST else ids
    asked = materialize(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), "asked")  # texts outside any pair are not shuffled
    of = lambda k: asked.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(alike("text_a", "text_b") >= least).select("a", "b")


def _meeting(mixed: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """Pairs ``(a, b)`` of ``mixed(node, n, label, size)`` with different labels, all those of a similarity of ``least`` or more among them.

    Sets of x and y shingles that are so similar share o = least / (1 + least) * (x + y) at least. Only shingles that
    documents of other labels have too can be shared: where one set has u of them, in an order that is the same for all,
    the pair shares one among the first u - o + 1 of either. Rare shingles come first, so few pairs do; the rest cannot be similar.
    """

    @pandas_udf("array<long>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t, words).view(np.int64) for t in texts], dtype="object")
        give_back()

    some = mixed.select(F.col("node").alias("doc_id"), "label")
    some = F.broadcast(some) if some.count() <= BROADCAST else some
    held = docs.select("doc_id", "text").join(some, "doc_id").select(F.col("doc_id").alias("node"), "label", parts("text").alias("h"))
    held = materialize(held.select("node", "label", F.explode("h").alias("h")), "held").repartition("h")
    shared = held.groupBy("h").agg(F.count("*").alias("k"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h", "k")
    own = held.select("node", "h").join(shared, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("order"))
    own = own.join(mixed, "node").withColumn("u", F.size("order").cast("long"))
    first = F.col("u") - F.ceil(least * F.col("n") - 1e-6) + 1  # the longest start that any partner asks for
    own = own.where(first > 0).select("node", "n", "label", "size", "u", F.posexplode(F.slice("order", F.lit(1), first.cast("int"))).alias("at", "x"))
    own = materialize(own.select("node", "n", "label", "size", "u", "at", F.col("x.h").alias("h")), "starts")

    groups = own.groupBy("h").agg(F.max(F.struct("size", "label")).alias("main"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    own = own.drop("size").join(groups.where("lo <> hi").select("h", F.col("main.label").alias("main")), "h")
    left = own.where("label <> main").select("h", *[F.col(c).alias(f"{c}_x") for c in ("node", "n", "label", "u", "at")])
    right = own.select("h", *[F.col(c).alias(f"{c}_y") for c in ("node", "n", "label", "u", "at")])
    o = F.ceil(least / (1 + least) * (F.col("n_x") + F.col("n_y")) - 1e-6)
    met = left.join(right, (left.h == right.h) & (F.col("label_x") != F.col("label_y")) & (F.col("at_x") <= F.col("u_x") - o) & (F.col("at_y") <= F.col("u_y") - o))
    return met.select(F.greatest("node_x", "node_y").alias("a"), F.least("node_x", "node_y").alias("b")).distinct()


def near_copies(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """Rows ``(doc_id, component_id)``: component_id is the smallest doc_id that links reach, the document's own included.

    doc_id is taken for a key. Null text counts as empty; all texts without words are copies of each other. Equal sets
    meet before any comparison, so exact copies cost nothing more. All that reads texts is run and written here, in small batches.
    """
    with small_batches(docs.sparkSession):
        return _near_copies(docs, words, least)


def _near_copies(docs: DataFrame, words: int, least: float) -> DataFrame:
    filed = materialize(_filed(docs, words), "filed")
    firsts = filed.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"))
    firsts = materialize(filed.select("doc_id", "digest").join(firsts, "digest"), "firsts")
    nodes = filed.join(firsts.where("doc_id = node").select("doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "node")
    own = materialize(nodes.select("node", "n", F.explode("keys").alias("key")), "bands")
    fits = lambda x, y: F.least(x, y) >= least * F.greatest(x, y)  # noqa: E731  sizes further apart cannot be so similar

    prints = nodes.where("n > 0").select("node", "n", "fp")  # searched by Hamming balls; the smallest node of a component is its pivot
    prints = materialize(prints.join(simhash.link(prints.select("fp").distinct()), "fp"), "prints")
    pivots = prints.groupBy("root").agg(F.min(F.struct("node", "n")).alias("p"), F.count("*").alias("k")).where("k > 1")
    balls = prints.join(pivots, "root").where((F.col("node") != F.col("p.node")) & fits(F.col("n"), F.col("p.n")))

    crowds = own.groupBy("key").agg(F.min(F.struct("node", "n")).alias("p"), F.count("*").alias("k")).where("k > 1")
    stars = own.join(crowds, "key").where((F.col("node") != F.col("p.node")) & fits(F.col("n"), F.col("p.n")))
    stars = balls.select("node", "p").unionByName(stars.select("node", "p"))
    stars = materialize(stars.select(F.col("node").alias("a"), F.col("p.node").alias("b")).distinct(), "stars")
    links = materialize(_verified(stars, docs, words, least), "links")
    labels = connected_components(links)
    sizes = labels.groupBy("root").agg(F.count("*").alias("size"))
    labels = materialize(labels.join(sizes, "root"), "labels")

    rows = own.join(crowds.select("key"), "key").join(labels, "node", "left")
    rows = rows.select("node", "n", "key", F.coalesce("root", "node").alias("label"), F.coalesce("size", F.lit(1)).alias("size"))
    buckets = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    mixed = materialize(rows.join(buckets, "key", "left_semi").drop("key").distinct(), "mixed")
    met = _meeting(mixed, docs, words, least).join(stars, ["a", "b"], "left_anti")
    across = _verified(met, docs, words, least)
    roots = connected_components(links.unionByName(across)).withColumnRenamed("root", "component_id")
    return firsts.join(roots, "node", "left").select("doc_id", F.coalesce("component_id", "node").alias("component_id"))


def keep_first(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """The documents without those that have a near copy with a smaller doc_id in their component; columns stay."""
    drop = near_copies(docs, words, least).where("doc_id <> component_id").select("doc_id")
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
