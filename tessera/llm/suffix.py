"""Exact duplicate passages by suffix arrays over shards.

A 400-byte string that also starts elsewhere is found where its copies are sure to meet. Of its first 250 start
positions the one with the least hash of 8 bytes is picked, the same one in every copy, as a window of a minimizer
scheme over the whole text; the 150 bytes from there are its key. Keys that occur once are dropped. For the others,
the context that holds every string of that pick (249 bytes before it, 400 from it) goes to the shard of its key.

Contexts that are equal byte for byte meet by their digests first: all their strings repeat, and one of them stands
for all in the shard. So a passage copied a million times costs the shard one context.

A key with more than ``most`` different contexts (a passage of 150 to 399 bytes that many documents share) is split
before it reaches a shard: its strings are dealt by their place around the pick into blocks of 25, then 5, then 1
start positions, and a block's key is all the bytes its strings have in common. Blocks whose keys occur once are
dropped, as they are above. A block of one position has the whole string as its key, so the splitting ends, and no
shard gets more than ``most`` contexts of one key.

A shard sorts the suffixes of its contexts by induced sorting: suffixes are classified, leftmost-smaller (LMS) ones
sorted, the rest induced in linear passes, bucket by bucket in NumPy. Prefixes that neighbours share are found in text
order (permuted common prefixes): only where the preceding bytes differ are bytes compared; from there the length
falls by one a step.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, tidy_shuffles

LENGTH = 400
STRIDE = 1 << 20  # longer texts are picked and hashed in overlapping pieces of so many start positions
WIDTHS = (25, 5, 1)
_MIX, _BASE = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D
SCREEN = 5  # start positions screened together in a shard


def suffix_array(text: np.ndarray, depth: int = 1 << 30, wanted: np.ndarray | None = None, stops: np.ndarray | None = None) -> np.ndarray:
    """The suffix array of small non-negative integers, by induced sorting. Order beyond ``depth`` LMS substrings (2 symbols each, at least) may be left open.

    With ``wanted`` (a mask), the array of those suffixes only. With ``stops`` (a place for each, which must be as far from any
    other suffix that is equal up to it), order from there on may be left open. Windows of two LMS substrings are sorted as
    packed symbols; equal ones are sorted by doubling or tripling over the reduced string: its alphabet is too large for
    passes bucket by bucket.
    """
    n = len(text)
    if n < 2:
        return np.arange(n) if wanted is None else np.flatnonzero(wanted)
    t = np.append(text.astype(np.int32) + np.int32(1), np.int32(0))  # a sentinel below all
    n += 1
    # Types: S if smaller than the next suffix. Runs of equal symbols take the type of what follows them.
    less = np.append(t[:-1] < t[1:], True)
    differs = np.flatnonzero(np.append(t[:-1] != t[1:], True))
    small = np.repeat(less[differs], np.diff(differs, prepend=-1))
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1

    m = len(lms)
    met = np.zeros(n + 1, np.int32)  # LMS suffixes before a place
    met[lms + 1] = 1
    np.cumsum(met, out=met)

    # What is kept: each suffix wanted is induced from the one after it, up to the next LMS suffix.
    here = np.arange(n, dtype=np.int32)
    if wanted is None:
        wanted = np.append(np.ones(n - 1, bool), False)
        kept = np.ones(n, bool)
    else:
        wanted = np.append(wanted, False)
        before = np.maximum.accumulate(np.where(wanted, here, np.int32(-1)))
        kept = (before >= 0) & (here <= np.append(lms, n - 1)[met[before + 1]])

    # 1. Windows of two LMS substrings in the order of their symbols.
    span = 2
    rank = np.append(_window_ranks(t, lms, np.append(lms[span:], np.full(min(span, m), n - 1))), -1)
    # 2. The order of the LMS suffixes: by ranks of two or three neighbours at once, while ranks repeat.
    size = m + 2
    step = 3 if size**3 < 1 << 62 else 2
    # LMS suffixes to a place's stop: beyond it nothing is compared. A group reaches its stops together.
    room = m - np.arange(m) if stops is None else met[np.append(stops, n - 1)[lms]] - np.arange(m)
    spans = [span]
    while spans[-1] * step <= min(depth, int(room.max())):
        spans.append(spans[-1] * step)
    # Which ranks each round has to give: the last those of suffixes kept, one before also those of the neighbours that are joined.
    asked = [kept[lms]]
    for w in spans[:0:-1]:
        more = asked[-1].copy()
        for j in range(1, step):
            more[j * w :] |= asked[-1][: max(0, m - j * w)]
        asked.append(more)
    # A rank is the place where its group begins, so that only groups of more than one are sorted again.
    count = np.bincount(rank[:m])
    live = np.flatnonzero(count[rank[:m]] > 1)
    for span, needed in zip(spans, asked[::-1]):
        live = live[(room[live] > span) & needed[live]]
        if not len(live):
            break
        joined = rank[live]
        for j in range(1, step):
            joined = joined * size + rank[np.minimum(live + j * span, m)] + 1
        order = np.argsort(joined)
        live, joined = live[order], joined[order]
        begin = rank[live]
        changed = np.append(True, begin[1:] != begin[:-1])
        new = changed | np.append(True, joined[1:] != joined[:-1])
        rank[live] = begin + _since(new, changed)
        live = live[~(new & np.append(new[1:], True))]
    # 3. The suffixes wanted, from the LMS ones.
    order = _induced(t, small, lms, rank[:m], kept)
    return order[wanted[order]]


def _since(new: np.ndarray, changed: np.ndarray) -> np.ndarray:
    """How far before each place its group (``new`` where one begins) begins, counted from the start of the group (``changed``) it is part of."""
    here = np.arange(len(new))
    return np.maximum.accumulate(np.where(new, here, 0)) - np.maximum.accumulate(np.where(changed, here, 0))


def _window_ranks(t: np.ndarray, start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For windows of LMS substrings (``last`` is theirs), the place where the group of equal ones begins. One that another goes on from comes after it."""
    packed = np.cumsum(np.bincount(t) > 0)
    bits = int(packed[-1]).bit_length()
    each, n = 63 // bits, len(t)
    packed = np.append(packed[t] - 1, np.zeros(each, np.int64))
    filling = (np.int64(1) << bits * np.arange(each + 1)) - 1
    rank, live, k = np.zeros(len(start), np.int64), np.arange(len(start)), 0
    while len(live):
        at = np.minimum(start[live] + k, n)
        joined = packed[at]
        for j in range(1, each):
            joined <<= bits
            joined |= packed[j:][at]
        joined |= filling[np.clip(each - 1 - last[live] + start[live] + k, 0, each)]
        order = np.argsort(joined) if k == 0 else np.lexsort((joined, rank[live]))
        live, joined = live[order], joined[order]
        begin = rank[live]
        changed = np.append(True, begin[1:] != begin[:-1])
        new = changed | np.append(True, joined[1:] != joined[:-1])
        rank[live] = begin + _since(new, changed)
        k += each
        # Equal so far, so all of a group go on, or none does: a window that ends within these symbols has filling there or is k long.
        long = np.logical_or.reduceat(last[live] - start[live] >= k, np.flatnonzero(new))[np.cumsum(new) - 1]
        live = live[long & ~(new & np.append(new[1:], True))]
    return rank


def _induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray, rank: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Suffixes in order, by induction from the LMS ones as ranked. With each suffix ``kept`` also holds those after it up to an LMS one."""
    n = len(t)
    inside = kept[lms]
    order = lms[inside][np.argsort(rank[inside], kind="stable")]
    sizes = np.bincount(t[kept], minlength=int(t.max()) + 1)
    narrow = np.uint16 if len(sizes) < 1 << 16 else np.int64  # short integers sort by radix
    top = np.cumsum(sizes)
    bottom = top - sizes
    large, low = kept & ~small, kept & small

    def file(own: np.ndarray, at: np.ndarray, step: int) -> None:
        before = own[own > 0] - 1
        before = before[(large if step == 1 else low)[before]]
        if not len(before):
            return
        c = t[before]
        by = np.argsort(c.astype(narrow), kind="stable")
        before, c = before[by], c[by]
        count = np.bincount(c, minlength=len(sizes))
        rank = np.arange(len(c)) - np.repeat(np.cumsum(count) - count, count)
        if step == 1:
            sa[at[c] + rank] = before
            at += count
        else:
            sa[at[c] - 1 - rank] = before
            at -= count

    sa = np.full(int(sizes.sum()), -1, np.int32)
    count = np.bincount(t[order], minlength=len(sizes))
    place = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(top - count, count)
    sa[place] = order
    head = bottom.copy()
    for c in np.flatnonzero(sizes).tolist():  # L suffixes, bucket by bucket upwards
        done = bottom[c]
        lms_from = top[c] - count[c]
        while True:
            upto = head[c] if done < head[c] else done
            own = sa[done:upto]
            if not len(own):
                break
            done = upto
            file(own, head, 1)
        file(sa[lms_from : top[c]], head, 1)
    sa[place] = -1
    if kept[n - 1]:
        sa[0] = n - 1
    rear = top.copy()
    for c in np.flatnonzero(sizes)[::-1].tolist():  # S suffixes, downwards
        done = top[c]
        while True:
            own = sa[rear[c] : done][::-1]
            if not len(own):
                break
            done = rear[c]
            file(own, rear, -1)
        file(sa[bottom[c] : head[c]][::-1], rear, -1)
    if kept[n - 1]:
        sa[0] = n - 1
    return sa[sa >= 0]  # LMS suffixes that nothing kept follows are not filed again


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """By rank, how many symbols a suffix shares with the one ranked before it, up to ``most`` (found in text order). Only the suffixes in ``sa`` count."""
    n = len(text)
    if len(sa) == 0:
        return np.zeros(0, np.int64)
    there = np.zeros(n, bool)
    there[sa] = True
    here = np.flatnonzero(there)
    where = np.full(n, -1, np.int64)
    where[sa[1:]] = sa[:-1]
    phi = where[here]
    # Irreducible places: no symbol before one of the two, or different ones. Elsewhere the length is that of the place before, less one.
    # Order beyond ``most`` symbols may be open, so the place before must have the matching neighbour.
    ok = np.flatnonzero((phi > 0) & np.append(False, here[1:] == here[:-1] + 1))
    ok = ok[(phi[ok - 1] == phi[ok] - 1) & (text[here[ok] - 1] == text[phi[ok] - 1])]
    irreducible = np.ones(len(here), bool)
    irreducible[ok] = False
    source = np.maximum.accumulate(np.where(irreducible, np.arange(len(here)), 0))
    reach = most + int((here - here[source]).max())  # the last place that takes its length from another has ``most`` left
    length = np.zeros(len(here), np.int64)
    live = np.flatnonzero(irreducible & (phi >= 0))
    # A word of symbols at a time, then one by one. Past the end stands what no text has, and two places never reach it together.
    narrow = np.uint8 if text.max() < 255 else np.int32
    wide = np.append(text.astype(narrow), np.full(8, np.array(-1).astype(narrow)))
    each = 8 // wide.itemsize
    words = np.ndarray(n + 1, np.int64, wide, 0, wide.itemsize).copy()
    k, part = 0, []
    while len(live) and k < reach:
        same = words[here[live] + k] == words[phi[live] + k]
        part.append(live[~same])
        length[part[-1]] = k
        live = live[same]
        k += each
    length[live] = k
    live = np.concatenate(part) if part else live[:0]
    for _ in range(each - 1):
        live = live[wide[here[live] + length[live]] == wide[phi[live] + length[live]]]
        length[live] += 1
    where[here] = np.minimum(np.maximum(0, length[source] - (here - here[source])), most)
    return where[sa]


def repeated_strings(contexts: list[bytes], owners: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context (a piece of document ``owners`` from byte ``starts``), which of its ``length``-byte strings also start at another place.

    A place is a document and a byte, so two contexts that overlap in one document do not repeat each other.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int((sizes + 1).sum()), np.int16)
    of = np.repeat(np.arange(len(contexts), dtype=np.int32), sizes + 1)
    stops = (base + sizes)[of]
    inner = np.ones(len(text), bool)
    inner[base + sizes] = False
    text[inner] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int16) + 1  # 0 parts contexts
    # Only whole strings are sorted; one that reaches over the end of its context never counts.
    ends = np.arange(len(text)) + length
    sa = suffix_array(text, depth=length // 2, wanted=ends <= stops, stops=np.minimum(ends, stops))
    flags = np.zeros(len(text), bool)
    if len(sa):
        lcp = common_prefixes(text, sa, length)
        # Runs of strings that agree in all their bytes. Another place: a run's members are not all at the first one's.
        new = np.append(True, lcp[1:] < length)
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        which = of[sa]
        doc, place = owners[which], starts[which] + sa - base[which]
        differs = (doc != doc[first][group]) | (place != place[first][group])
        flags[sa[np.logical_or.reduceat(differs, first)[group]]] = True
    return [flags[b : b + max(0, s - length + 1)] for b, s in zip(base.tolist(), sizes.tolist())]


def repeated_cuts(cuts: list[bytes], owners: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """As ``repeated_strings``, but cuts that are equal byte for byte are sorted once: where they stand at two places, all their strings repeat."""
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(c, i) for i, c in enumerate(cuts)], np.int64)
    twice = np.zeros(len(cuts), bool)
    twice[which[(owners != owners[which]) | (starts != starts[which])]] = True
    ones = np.fromiter(seen.values(), np.int64, len(seen))
    flags = dict(zip(ones.tolist(), repeated_strings([*seen], owners[ones], starts[ones], length)))
    for i in np.flatnonzero(twice).tolist():
        flags[i][:] = True
    return [flags[i] for i in which.tolist()]


def screen(pieces: list[bytes], picks: np.ndarray, length: int = LENGTH, block: int = SCREEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which runs of strings are worth sorting: ``(piece, first start, last start)`` of each.

    The start positions of a piece are dealt into blocks by their place before its pick, which is the same in every copy. All
    strings of a block share ``length - block + 1`` bytes; where no other piece has those at that place, none of them repeats.
    The bytes are compared by a hash, so a block may stay in vain, but none goes that has a partner.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    base = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    rounds = int(picks.max()) // block + 1
    of = np.repeat(np.arange(len(pieces)), rounds)
    turn = np.tile(np.arange(rounds), len(pieces))
    last = picks[of] - turn * block
    first = np.maximum(last - block + 1, 0)
    end = last - block + 1 + length
    ok = (last >= 0) & (first + length <= sizes[of]) & (end <= sizes[of])
    of, turn, last, first, end = (x[ok] for x in (of, turn, last, first, end))
    with np.errstate(over="ignore"):
        sums, power = _prefix_hash(raw, _BASE)
        h = (sums[base[of] + end] - sums[base[of] + last]) * power[base[of] + last] * np.uint64(_MIX) + turn.astype(np.uint64)
    _, same, count = np.unique(h, return_inverse=True, return_counts=True)
    go = count[same] > 1
    of, first, last = of[go], first[go], np.minimum(last, sizes[of] - length)[go]
    if not len(of):
        return of, first, last
    order = np.lexsort((first, of))
    of, first, last = of[order], first[order], last[order]
    new = np.append(True, (of[1:] != of[:-1]) | (first[1:] > last[:-1] + 1))
    at = np.flatnonzero(new)
    return of[at], first[at], last[np.append(at[1:], len(of)) - 1]


@functools.lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2^bits powers of base and of its inverse, modulo 2^64."""
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        row = np.full(1 << bits, factor, np.uint64)
        row[0] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return tuple(out)


def _prefix_hash(raw: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of raw[i] * base^-i, powers of base), all modulo 2^64."""
    power, down = _powers(base, max(16, (len(raw) + 1).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[: len(raw)], out=sums[1:], dtype=np.uint64)
    return sums, power


def window_of(length: int) -> int:
    """How many start positions a pick is the least of; the bytes of a string after them are its key."""
    return length * 5 // 8


def picks(raw: bytes, length: int = LENGTH) -> np.ndarray:
    """Start positions of the minimizers: for each ``length``-byte string, the least-hashed 8 bytes of its first ``window_of(length)`` positions (the first of equals)."""
    n, window = len(raw), window_of(length)
    if n < length:
        return np.zeros(0, np.int64)
    grams = np.ndarray(n, "<u8", raw + bytes(8), 0, 1).copy()
    with np.errstate(over="ignore"):
        h = grams * np.uint64(_MIX)
        h ^= h >> np.uint64(29)
        h *= np.uint64(_BASE)
        h >>= np.uint64(24)
    m = n - length + window  # positions that can be picked
    # The place in the low bits makes the first of equals the least; the order of values stays.
    v = (h[:m] & ~np.uint64((1 << 24) - 1)) | np.arange(m, dtype=np.uint64)
    pad = -m % window
    blocks = np.append(v, np.full(pad, np.uint64(2**64 - 1))).reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[:m]
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:m]
    best = np.minimum(back[: m - window + 1], ahead[window - 1 :])
    at = (best & np.uint64((1 << 24) - 1)).astype(np.int64)
    return at[np.append(True, at[1:] != at[:-1])]  # the least of a sliding window never moves back


def occurrences(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, keys, digests of contexts) of a text's picks."""
    if len(raw) > STRIDE + length:
        parts = []
        for s in range(0, len(raw) - length + 1, STRIDE):
            base = max(0, s - length)
            at, key, mixed = _hashed(raw[base : s + STRIDE + 2 * length], picks(raw[s : s + STRIDE + length - 1], length) + s - base, length)
            parts.append((at + base, key, mixed))
        at, key, mixed = (np.concatenate(c) for c in zip(*parts))
        at, one = np.unique(at, return_index=True)
        return at, key[one], mixed[one]
    return _hashed(raw, picks(raw, length), length)


def _hashed(raw: bytes, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none
    r = np.frombuffer(raw, np.uint8)
    window = window_of(length)
    core = length - window
    lo, hi = np.maximum(0, at - window + 1), np.minimum(len(raw), at + length)
    with np.errstate(over="ignore"):
        sums, power = _prefix_hash(r, _BASE)
        key = (sums[at + core] - sums[at]) * power[at]
        key = (key ^ key >> np.uint64(32)) * np.uint64(_MIX)
    digests = b"".join([_digest(raw[a:b], p - a) for a, p, b in zip(lo.tolist(), at.tolist(), hi.tolist())])
    return at, key.view(np.int64), np.frombuffer(digests, np.int64)  # (sums[b] - sums[a]) * base^a is the same wherever a string stands


def _digest(context: bytes, pick: int) -> bytes:
    """Eight bytes of BLAKE2b over a context and the place of its pick."""
    return hashlib.blake2b(context, digest_size=8, salt=pick.to_bytes(4, "little")).digest()


def find_picks(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows ``(doc_id, at, key, context)``, made as flat columns a few hundred texts at a time."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 400):
                part = batch.slice(a, 400)
                got = [occurrences((t.as_py() or "").encode(), length) for t in part.column(1)]
                of = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
                at, key, ctx = (np.concatenate([g[k] for g in got]) for k in range(3))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(at.astype(np.int32)), pa.array(key), pa.array(ctx)], ["doc_id", "at", "key", "context"])

    return docs.select("doc_id", "text").mapInArrow(found, f"doc_id {dict(docs.dtypes)['doc_id']}, at int, key long, context long")


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(starts[order].tolist(), ends[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_pieces(docs: DataFrame, wanted: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows ``(doc_id, pick, key, asks, kinds, start, piece)``: the bytes of the contexts of picks ``(doc_id, at, key, asks, kinds)``. The only time texts meet picks."""
    width = window_of(length)
    places = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("at", "key", "asks", "kinds")).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                ids, texts, found = batch.slice(a, 200).columns
                of, out = [], []
                for i, (t, ps) in enumerate(zip(texts, found)):
                    raw = (t.as_py() or "").encode()
                    for p in ps.as_py():
                        start = max(0, p["at"] - width + 1)
                        of.append(i)
                        out.append((p["at"], p["key"], p["asks"], p["kinds"], start, raw[start : p["at"] + length]))
                kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())
                cols = [pa.array(list(c), k) for c, k in zip(zip(*out) if out else ((),) * 6, kinds)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int64())), *cols], ["doc_id", "pick", "key", "asks", "kinds", "start", "piece"])

    joined = docs.select("doc_id", "text").join(places, "doc_id").select("doc_id", "text", "places")
    return joined.mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, pick int, key long, asks boolean, kinds long, start int, piece binary")


def split_blocks(hot: DataFrame, width: int, into: int, length: int = LENGTH) -> DataFrame:
    """Rows ``(doc_id, at, pick, key, context, asks)``: blocks of ``width`` start positions that end at ``at``, cut into blocks of ``into``.

    ``hot`` has (doc_id, at, pick, key, asks) and the piece of the pick, with its start.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                ids, *cols = batch.slice(a, 2_000).columns
                of, rows = [], []
                for i, (at, pick, key, asks, start, piece) in enumerate(zip(*[c.to_pylist() for c in cols])):
                    for j in range(-(-width // into)):
                        last = at - j * into
                        end = last - into + 1 + length
                        if last < 0 or end - start > len(piece):
                            continue
                        core = xxhash.xxh3_64_intdigest(piece[last - start : end - start], (key + j) % (1 << 64))
                        whole = _digest(piece[max(0, last - into + 1) - start : last + length - start], min(last, into))
                        of.append(i)
                        rows.append((last, pick, core - (1 << 63), int.from_bytes(whole, "little", signed=True), asks))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
                made = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else ((),) * 5, kinds)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int64())), *made], ["doc_id", "at", "pick", "key", "context", "asks"])

    kind = dict(hot.dtypes)["doc_id"]
    return hot.select("doc_id", "at", "pick", "key", "asks", "start", "piece").mapInArrow(cut, f"doc_id {kind}, at int, pick int, key long, context long, asks boolean")


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard_contexts: int = 2_000, most: int = 500) -> tuple[DataFrame, list[DataFrame]]:
    """Rows ``(doc_id, a, b)``: byte spans (end exclusive) whose strings of ``length`` bytes repeat; they may overlap. One doc_id must mean one text.

    A row that is there twice counts twice. Also returns the tables it reads, to discard once the rows are written.
    """
    kind = dict(docs.dtypes)["doc_id"]
    twice = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    width = window_of(length)
    picked = materialize(find_picks(docs, length), "picks")
    # Written before they are joined: a join right after an aggregation is one that Spark does not split at a hot key.
    keys = materialize(picked.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    blocks = materialize(picked.join(keys, "key").withColumn("asks", F.lit(True)).withColumn("pick", F.col("at")), "again")
    discard(picked, keys)
    used, spans, few = [blocks], [], []
    pieces = None
    for into in (*(w for w in WIDTHS if w < width), 0):
        one = F.min(F.struct("doc_id", "at", "pick", "asks")).alias("one")
        contexts = materialize(blocks.groupBy("key", "context").agg(F.count("*").alias("n"), one), "contexts")
        # Contexts met more than once: every string in them repeats.
        many = blocks.where("asks").join(contexts.where("n > 1").select("key", "context"), ["key", "context"])
        spans.append(many.select("doc_id", F.greatest(F.col("at") - width + 1, F.lit(0)).alias("a"), (F.col("at") + length).alias("b")))
        # The others are held against all contexts of their key, one for each.
        asking = F.max(F.expr("n = 1 and one.asks")).alias("asking")
        mixed = contexts.groupBy("key").agg(F.count("*").alias("kinds"), asking).where("kinds > 1 and asking").select("key", "kinds")
        mixed = materialize(mixed, "mixed")
        reps = contexts.join(mixed, "key").select("key", "one.doc_id", "one.at", "one.pick", F.expr("n = 1 and one.asks").alias("asks"), "kinds")
        if pieces is None:
            pieces = cut_pieces(docs, reps, length)
            pieces = materialize(pieces.dropDuplicates(["doc_id", "pick", "key"]) if twice else pieces, "pieces")
            used.append(pieces)
            found = pieces.withColumn("at", F.col("pick"))
            pieces = pieces.where(F.col("kinds") > most)  # all that later rounds look at
        else:
            found = materialize(reps.join(pieces.select("doc_id", "pick", "start", "piece"), ["doc_id", "pick"]), "split")
            used.append(found)
        discard(mixed)
        used.append(contexts)
        begin = F.greatest(F.col("at") - width + 1, F.lit(0))
        own = F.expr(f"substring(piece, greatest(at - {width - 1}, 0) - start + 1, at + {length} - greatest(at - {width - 1}, 0))")
        last = found.where(F.col("kinds") <= most) if into else found
        few.append(last.select("key", "doc_id", begin.alias("start"), (F.col("at") - begin).alias("pick"), "asks", own.alias("piece")))
        hot = found.where(F.col("kinds") > most)
        if not into or hot.isEmpty():
            break
        blocks = materialize(split_blocks(hot, width, into, length), "blocks")
        used.append(blocks)
        width = into
    asked = few[0]
    for more in few[1:]:
        asked = asked.unionByName(more)
    shards = max(1, -(-asked.count() // shard_contexts))
    shard = F.pmod(F.col("key"), F.lit(shards)).alias("shard")
    asked = asked.select(shard, "doc_id", "start", "pick", "asks", "piece")

    def sort_shard(frame: pd.DataFrame) -> pd.DataFrame:
        owner, names = pd.factorize(frame["doc_id"], sort=True)
        frame = frame.assign(owner=owner).sort_values(["owner", "start"], kind="stable")
        pieces, ids, start, asks = frame["piece"].tolist(), frame["owner"].to_numpy(), frame["start"].to_numpy(np.int64), frame["asks"].to_numpy()
        of, first, last = screen(pieces, frame["pick"].to_numpy(np.int64), length)
        cut = [pieces[i][a : b + length] for i, a, b in zip(of.tolist(), first.tolist(), last.tolist())]
        flags = repeated_cuts(cut, ids[of], start[of] + first, length)
        # Runs of repeated strings, over all cuts at once: a place that is none parts them.
        size = np.array([len(f) + 1 for f in flags], np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate([x for f in flags for x in (f, [False])] + [[False]]).astype(np.int8), prepend=0))
        a, b = edge[::2], edge[1::2]
        which = np.searchsorted(np.cumsum(size), a, side="right")
        shift = (np.cumsum(size) - size)[which] - start[of[which]] - first[which]
        asked = asks[of[which]]
        rows = {"doc_id": [names[k] for k in ids[of[which]][asked].tolist()], "a": (a - shift)[asked], "b": (b - shift - 1 + length)[asked]}
        return pd.DataFrame(rows)

    found = asked.groupBy("shard").applyInPandas(sort_shard, f"doc_id {kind}, a int, b int")
    for more in spans:
        found = found.unionByName(more.select("doc_id", F.col("a").cast("int"), F.col("b").cast("int")))
    return found, used


def remove_repeats(docs: DataFrame, length: int = LENGTH, most: int = 500) -> DataFrame:
    """Rows ``(doc_id, spans array<struct<a,b>>, kept binary, n_bytes)``: maximal removed runs, and the bytes left, of each document.

    Null text counts as empty; documents shorter than ``length`` keep all. Extra columns are ignored. Rows are known by 96
    bits of a hash of their id and text, so ids may repeat or be null; a row that is there twice repeats itself.
    """
    row = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))), 256), 1, 24)).alias("row")
    named = docs.select("doc_id", "text", row)
    with tidy_shuffles(docs.sparkSession):
        found, used = repeated_spans(named.select(F.col("row").alias("doc_id"), "text"), length, most=most)
        spans = materialize(found.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("s")), "spans")
        discard(*used)

    kind = dict(docs.dtypes)["doc_id"]
    span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                ids, texts, found = batch.slice(at, 200).columns
                spans_, kept, sizes = [], [], []
                for t, s in zip(texts, found):
                    raw = (t.as_py() or "").encode()
                    s = s.as_py()
                    runs = _merged(np.array([x["a"] for x in s]), np.minimum(len(raw), np.array([x["b"] for x in s])))
                    edges = [0, *(x for r in runs for x in r), len(raw)]
                    spans_.append([{"a": a, "b": b} for a, b in runs])
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    sizes.append(len(raw))
                yield pa.RecordBatch.from_arrays([ids, pa.array(spans_, span), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "spans", "kept", "n_bytes"])

    text = F.coalesce("text", F.lit(""))
    joined = named.join(spans.withColumnRenamed("doc_id", "row"), "row", "left").drop("row")
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    touched = joined.where("s is not null").select("doc_id", "text", "s").mapInArrow(removed, f"doc_id {kind}, spans array<struct<a:int,b:int>>, kept binary, n_bytes long")
    return touched.unionByName(joined.where("s is null").select("doc_id", none.alias("spans"), text.cast("binary").alias("kept"), F.octet_length(text).cast("long").alias("n_bytes")))


def op9_suffix(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of ``documents``."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
