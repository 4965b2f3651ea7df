"""Removal of word windows that repeat anywhere, by super-k-mers.

A window is ``width`` consecutive words of one document. Its minimiser is the stretch of ``MINIMISER`` words in it
with the least hash, the first of equal ones; equal windows have equal minimisers at equal places. Consecutive
windows that share one travel as one packed string (the words they cover) to the minimiser's bucket.

1. Count minimisers by their 64-bit hash. A window whose minimiser is met once repeats nowhere, so only the others travel.
2. Equal packed strings are counted before and after the shuffle. All windows of one that is met twice repeat.
3. A bucket of up to ``most`` different strings is sorted window by window in one task with others. A larger one (a
   passage in very many documents) is cut into windows, dealt and counted by their words, so that no task holds it.
4. What comes back are the windows met once. Their string is met once, so it belongs to one row: no join with the
   strings is needed. All other windows that travelled repeat.

Rows are known by 124 bits of hashes of their text, not by doc_id, as equal texts have equal results. The minimisers
asked for are known by 64 of these bits; a collision there makes more strings travel and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, table, text_or_empty, tidy_shuffles

WIDTH, MINIMISER = 35, 8
SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def super_kmers(words: list[bytes], width: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, window after the last, and minimiser hash (signed 64 bits) of each run of windows that share a minimiser."""
    n = len(words) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + one[i : i + len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    place = np.lib.stride_tricks.sliding_window_view(h, width - size + 1).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return first, np.append(first[1:], n), h[place[first]].view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("row"))


def find_minimisers(docs: DataFrame, width: int, size: int) -> DataFrame:
    """Rows ``(row, key, n)``: how often a text has a minimiser, once for each row of ``docs``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                rows, texts = batch.slice(at, 1_000).columns
                keys, times, sizes = [], [], []
                for t in texts:
                    key, n = np.unique(super_kmers(t.as_py().encode().split(), width, size)[2], return_counts=True)
                    keys.append(key)
                    times.append(n)
                    sizes.append(len(key))
                of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays([rows.take(of), pa.array(np.concatenate(keys)), pa.array(np.concatenate(times))], ["row", "key", "n"])

    return _texts(docs).select("row", "text").mapInArrow(find, "row long, key long, n long")


def pack(asked: DataFrame, width: int, size: int) -> DataFrame:
    """Rows ``(key, packed, n, row, proof, start)`` of ``asked(row, proof, text, keys)``: packed words of the windows of the keys asked for.

    Equal strings of 200 texts are one row; its row, proof and start are of one of them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                found: dict = {}
                for row, proof, text, keys in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns)):
                    words = text.encode().split()
                    first, end, key = super_kmers(words, width, size)
                    mine = np.isin(key, np.array(keys, np.int64))
                    for a, b, k in zip(first[mine].tolist(), end[mine].tolist(), key[mine].tolist()):
                        packed = b" ".join(words[a : b + width - 1])
                        held = found.get((k, packed))
                        if held is None:
                            found[k, packed] = [1, row, proof, a]
                        else:
                            held[0] += 1
                if found:
                    keys, strings = zip(*found)
                    n, rows, proofs, starts = zip(*found.values())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64()), pa.array(strings, pa.binary()), *(pa.array(c, pa.int64()) for c in (n, rows, proofs, starts))], ["key", "packed", "n", "row", "proof", "start"]
                    )

    return asked.select("row", "proof", "text", "keys").mapInArrow(cut, "key long, packed binary, n long, row long, proof long, start long")


def _windows(packed: bytes, width: int) -> list[bytes]:
    """The packed string's windows, each as its words joined by one space."""
    ends = np.append(np.flatnonzero(np.frombuffer(packed, np.uint8) == 32), len(packed))
    begins = np.append(0, ends[:-1] + 1)
    return [packed[a:b] for a, b in zip(begins[: len(ends) - width + 1].tolist(), ends[width - 1 :].tolist())]


def sort_bucket(frame: pd.DataFrame, width: int) -> pd.DataFrame:
    """Rows ``(row, proof, start)`` of the windows met once in their bucket, by sorting the windows of all buckets in the frame."""
    cols = [frame[c].tolist() for c in ("key", "n", "row", "proof", "start")]
    all_ = []
    for i, (key, packed) in enumerate(zip(cols[0], frame["packed"])):
        all_ += [(key, w, i, j) for j, w in enumerate(_windows(packed, width))]
    all_.sort()
    out, last, total = [], None, len(all_)
    for at, (key, w, i, j) in enumerate(all_):
        now = (key, w)
        if cols[1][i] == 1 and now != last and (at + 1 == total or all_[at + 1][1] != w or all_[at + 1][0] != key):
            out.append((cols[2][i], cols[3][i], cols[4][i] + j))
        last = now
    return pd.DataFrame(out, columns=["row", "proof", "start"])


def single_windows(hot: DataFrame, width: int) -> DataFrame:
    """Rows ``(row, proof, start)`` of the windows met once among ``hot(key, packed, n, row, proof, start)``, counted window by window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                key, packed, n, row, proof, start = batch.slice(at, 500).columns
                of, cuts, place = [], [], []
                for i, p in enumerate(packed):
                    w = _windows(p.as_py(), width)
                    of += [i] * len(w)
                    cuts += w
                    place += range(len(w))
                of = pa.array(of, pa.int64())
                starts = pa.array(start.to_numpy()[of.to_numpy()] + np.array(place, np.int64))
                yield pa.RecordBatch.from_arrays([key.take(of), pa.array(cuts, pa.binary()), n.take(of), row.take(of), proof.take(of), starts], ["key", "window", "n", "row", "proof", "start"])

    cut_up = hot.select("key", "packed", "n", "row", "proof", "start").mapInArrow(cut, "key long, window binary, n long, row long, proof long, start long")
    counted = cut_up.groupBy("key", "window").agg(F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("row", "proof", "start")))
    return counted.where("n = 1").select("row", "proof", "start")


def remove_windows(docs: DataFrame, width: int = WIDTH, size: int = MINIMISER, most: int = 2_000, shard_strings: int = 4_000) -> DataFrame:
    """Rows ``(doc_id, n_words, spans array<struct<a,b>>, kept)``: maximal removed runs of words (end exclusive), and the words left joined by one space.

    A word goes if a window of ``width`` words that covers it also starts elsewhere, in this document or another.
    Words are what ASCII white space parts and are compared as they are. Null text counts as empty; texts of fewer
    words than ``width`` keep all. Ids are only passed on, so they may repeat or be null: rows with equal texts count
    as different places. Other columns are ignored. ``size`` must be at most ``width``.
    """
    if not 1 <= size <= width:
        raise ValueError("a minimiser has 1 to width words")
    with tidy_shuffles(docs.sparkSession):
        # Tables are written before they are joined: a join right after an aggregation is one that Spark does not split at a hot key.
        met = materialize(find_minimisers(docs, width, size), "minimisers")
        keys = materialize(met.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "keys")
        wanted = materialize(met.join(keys, "key").groupBy("row").agg(F.collect_set("key").alias("keys")), "wanted")
        discard(met, keys)
        proof = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long").alias("proof")
        asked = _texts(docs).select("row", "text", proof).join(wanted, "row")
        strings = pack(asked, width, size).groupBy("key", "packed").agg(F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("row", "proof", "start")))
        strings = materialize(strings, "strings")
        buckets = strings.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest")).where("fewest = 1").select("key", "kinds")
        buckets = materialize(buckets, "buckets")
        found = strings.join(buckets, "key")
        few = found.where(F.col("kinds") <= most)
        shards = max(1, -(-(buckets.where(F.col("kinds") <= most).agg(F.sum("kinds")).first()[0] or 0) // shard_strings))
        few = few.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "packed", "n", "row", "proof", "start")
        once = few.groupBy("shard").applyInPandas(lambda frame: sort_bucket(frame, width), "row long, proof long, start long")
        once = once.unionByName(single_windows(found.where(F.col("kinds") > most), width))
        single = materialize(once.groupBy("row", "proof").agg(F.collect_list("start").alias("starts")), "single")
        discard(strings, buckets)
        of_row = single.groupBy("row").agg(F.collect_list(F.struct("proof", "starts")).alias("once"))
        marks = materialize(wanted.join(of_row, "row", "left"), "marks")
        discard(wanted, single)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                ids, texts, keys, proofs, once = batch.slice(at, 200).columns
                sizes, spans, kept = [], [], []
                for t, k, p, o in zip(texts, keys.to_pylist(), proofs.to_pylist(), once.to_pylist()):
                    words = t.as_py().encode().split()
                    sizes.append(len(words))
                    gone = np.zeros(len(words) + 1, np.int64)
                    if k:
                        first, end, key = super_kmers(words, width, size)
                        repeats = np.repeat(np.isin(key, np.array(k, np.int64)), end - first)
                        repeats[[s for x in o or () if x["proof"] == p for s in x["starts"]]] = False
                        starts = np.flatnonzero(repeats)
                        np.add.at(gone, starts, 1)
                        np.add.at(gone, starts + width, -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    spans.append([{"a": a, "b": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())])
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.string())], ["doc_id", "n_words", "spans", "kept"])

    proof = F.when(F.col("keys").isNotNull(), proof).alias("proof")
    joined = _texts(docs).join(marks, "row", "left").select("doc_id", "text", "keys", proof, "once")
    return joined.mapInArrow(remove, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, spans array<struct<a:int,b:int>>, kept string")


def op12_word_windows(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of ``documents``."""
    found = remove_windows(table(spark, sf_dir, "documents"))
    removed = F.expr("aggregate(spans, 0L, (s, x) -> s + x.b - x.a)")
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
