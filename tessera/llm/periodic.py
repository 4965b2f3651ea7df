"""Periodic runs of words, found by Kolpakov and Kucherov's method.

A suffix automaton, read word by word, cuts the sequence into Lempel-Ziv factors: each is a word not met before or
the longest stretch that also starts earlier (overlap allowed). Take a run [i, j) of period q and the factor k
that holds its last word.

* i lies at or before that factor's first word b: the run crosses b. The factor before would have been longer if a
  whole period lay in front of it, so i + q lies beyond its first word. With an exponent of e or more this gives
  (e - 1) * q < |factor k - 1| + |factor k|, which bounds the periods and the stretch to the left that Main's
  algorithm looks at: for each q, common extensions to both sides of b, from Z-functions.
* i lies behind b and j is the factor's end: the same step at the next border finds it, as it lies in one factor.
* Otherwise the run lies strictly inside the factor, and so does a copy of it in the factor's earlier occurrence,
  whose runs are known by then: it is copied from there.

A word of a run of exponent e is met at least e times, so words met less often are cut out first; the method is
applied to each stretch between them (a neighbour met less often extends no run).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

EXPONENT, LEAST = 4, 6
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Automaton:
    """A suffix automaton over any hashable symbols. A state's first edge lies in two lists, further edges in a dict of that state."""

    def __init__(self):
        self.symbol, self.target, self.more = [None], [-1], {}
        self.link, self.size, self.first, self.last = [-1], [0], [-1], 0

    def step(self, state: int, c) -> int:
        if self.symbol[state] == c:
            return self.target[state]
        edges = self.more.get(state)
        return -1 if edges is None else edges.get(c, -1)

    def _lead(self, state: int, c, to: int) -> None:
        if self.target[state] < 0 or self.symbol[state] == c:
            self.symbol[state], self.target[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _new(self, size: int, first: int) -> int:
        self.symbol.append(None)
        self.target.append(-1)
        self.link.append(0)
        self.size.append(size)
        self.first.append(first)
        return len(self.size) - 1

    def extend(self, c, at: int) -> tuple[int, int]:
        """Append the symbol at position ``at``. If a state had to be split, gives it and the new state of its shorter strings, else (-1, -1)."""
        p, new = self.last, self._new(self.size[self.last] + 1, at)
        self.last = new
        while p >= 0 and (q := self.step(p, c)) < 0:
            self._lead(p, c, new)
            p = self.link[p]
        if p < 0:
            return -1, -1
        if self.size[q] == self.size[p] + 1:
            self.link[new] = q
            return -1, -1
        half = self._new(self.size[p] + 1, self.first[q])
        self.symbol[half], self.target[half], self.link[half] = self.symbol[q], self.target[q], self.link[q]
        if q in self.more:
            self.more[half] = dict(self.more[q])
        while p >= 0 and self.step(p, c) == q:
            self._lead(p, c, half)
            p = self.link[p]
        self.link[q] = self.link[new] = half
        return q, half


def factors(w) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors (start, length, start of the first occurrence, or -1 for a symbol not met before)."""
    found, machine, begin, state = [], Automaton(), 0, 0
    for at, c in enumerate(w):
        to = machine.step(state, c)
        if to < 0 and at > begin:
            found.append((begin, at - begin, machine.first[state] + 1 - (at - begin)))
            begin, state = at, 0
            to = machine.step(0, c)
        was, half = machine.extend(c, at)
        if to < 0:
            found.append((at, 1, -1))
            begin, state = at + 1, 0
            continue
        if state == was and at - begin <= machine.size[half]:
            state = half
        state = machine.step(state, c)
    if begin < len(w):
        found.append((begin, len(w) - begin, machine.first[state] + 1 - (len(w) - begin)))
    return found


def z_values(w) -> list[int]:
    """For each position, how far the sequence from there agrees with the sequence's beginning; its length for position 0."""
    n = len(w)
    z, left, right = [n] * min(n, 1) + [0] * (n - 1), 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def crossing(w, low: int, border: int, high: int, longest: int, exponent: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Runs (start, end, period) with periods up to ``longest`` that touch the border and lie in [low, high): Main's step."""
    gap = [None]
    right, left = w[border:high], w[low:border][::-1]
    of_right, of_left = z_values(right), z_values(left)
    both = z_values(right + gap + w[low:high])[len(right) + 1 :]  # agreement of each position's sequel with the sequel of the border
    back = z_values(left + gap + w[low:high][::-1])[len(left) + 1 :]  # agreement to the left, by distance from ``high``
    for q in range(1, longest + 1):
        ends = []
        if q <= len(left):  # a whole period before the border
            ends.append((border - q - (of_left[q] if q < len(left) else 0), border + both[border - q - low]))
        if q <= len(right):  # a whole period after it
            at = high - border - q
            ends.append((border - (back[at] if at < len(back) else 0), border + q + (of_right[q] if q < len(right) else 0)))
        for i, j in ends:
            if j - i >= max(least, exponent * q) and (j == len(w) or w[j] != w[j - q]) and (i == 0 or w[i - 1] != w[i - 1 + q]):
                yield i, j, q


def runs(w: list, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All (start, end, smallest period) of maximal periodic stretches of ``least`` symbols and ``exponent`` (2 or more) periods at least, by start."""
    cut, at, kept = factors(w), 0, {}

    def add(i: int, j: int, q: int) -> None:
        ends = kept.setdefault(i, {})
        ends[j] = min(q, ends.get(j, q))

    before = 0
    for at, size, source in [*cut, (len(w), 0, -1)]:
        if (longest := (before + size - 1) // (exponent - 1)) > 0:
            for run in crossing(w, max(0, at - before - longest), at, at + size, longest, exponent, least):
                add(*run)
        if source >= 0:
            for x in range(source + 1, source + size - least):
                for j, q in list(kept.get(x, {}).items()):
                    if j < source + size:
                        add(x + at - source, j + at - source, q)
        before = size
    return sorted((i, j, q) for i, ends in kept.items() for j, q in ends.items())


def stretches(words: list, exponent: int, least: int, depth: int = 3) -> Iterator[tuple[int, list]]:
    """(start, words) of the stretches that can hold runs: ``least`` words or more, each met ``exponent`` times or more in the stretch."""
    todo = [(0, words, depth)]
    while todo:
        start, part, left = todo.pop()
        counts = Counter(part)
        rare = [-1, *(i for i, n in enumerate(map(counts.__getitem__, part)) if n < exponent), len(part)]
        for a, b in zip(rare, rare[1:]):
            if b - a > least:
                piece = part[a + 1 : b]
                if left and len(piece) < len(part):
                    todo.append((start + a + 1, piece, left - 1))
                else:
                    yield start + a + 1, piece


def text_runs(text: str | None, exponent: int = EXPONENT, least: int = LEAST) -> tuple[list[tuple[int, int, int]], str]:
    """Runs (start, length, period) of the text's words by start and period, and its words without the repeats, joined by one space."""
    words = (text or "").encode().split()  # bytes: ASCII white space only
    found = []
    for start, part in stretches(words, exponent, least):
        number: dict = {}
        found += [(start + i, j - i, q) for i, j, q in runs([number.setdefault(x, len(number)) for x in part], exponent, least)]
    found.sort(key=lambda r: (r[0], r[2]))
    kept, done = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in found):
        kept += words[done:a]  # empty where spans overlap
        done = max(done, b)
    return found, b" ".join(kept + words[done:]).decode()


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """Rows ``(doc_id, runs array<struct<start,length,period>>, collapsed)`` for each row of ``docs``.

    A run is a maximal stretch of words with smallest period q, of max(least, exponent * q) words or more; ``runs``
    is in order of start and period, and ``collapsed`` has the words outside all repeats (what follows a run's first
    q words), joined by one space. Words are what ASCII white space parts. Null text counts as empty: no runs,
    collapsed empty. Ids are only passed on, so they may repeat or be null; other columns are ignored. A document
    is worked on in one task, with memory in proportion to its longest stretch of words met ``exponent`` times.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, texts = batch.slice(at, 500).columns
                got = [text_runs(t.as_py(), exponent, least) for t in texts]
                found = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r, _ in got]
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, kind), pa.array([c for _, c in got], pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {dict(docs.dtypes)['doc_id']}, runs {RUNS}, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with the contract's periodic tails: a tenth of the documents, by the CRC-32 of the id, repeat p words from word a on (null ids: none)."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            out = []
            for i, t in zip(ids.to_pylist(), texts):
                h = 1 if i is None else zlib.crc32(str(i).encode())
                t = t.as_py()
                if h % 10 == 0 and (words := (t or "").encode().split()):
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    t = b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode()
                out.append(t)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(plant, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of ``documents``, with its periodic tails."""
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    best = "aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (m, r) -> if(m is null or r.length * m.period > m.length * r.period, r, m))"
    lines = "concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))"
    return found.withColumn("best", F.expr(best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.expr(lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
