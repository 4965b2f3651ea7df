"""Encoding and decoding with merge-type SentencePiece vocabularies."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import Generations, give_back, kept, slices, without_cycles

SPACE = "▁"
BORDER = re.compile(r"(?<=[^\W_])[\W_]|(?<=[\W_]).", re.S)
CHUNK = re.compile("\n[^▁\n]*|▁+[^▁\n]*")


CACHE = 200_000
SHORT = 31  # characters of the longest chunk whose agenda is a column among others
COLUMNS = 16_384  # chunks merged in step


class Pieces:
    """A merge-type vocabulary: an agenda of adjacent symbol pairs, best score first, then leftmost.

    No piece holds a space mark after another character or a line feed beside one (checked on loading), so a text
    can be cut before each run of space marks and around line feeds without changing its pieces. What became of such
    chunks, and of the parts of long ones, is kept in two generations of ``cache`` entries at most: what is met again stays.
    Chunks of up to ``SHORT`` characters have their agendas side by side in arrays, and each round takes the best entry of every
    one (``merge_many``); longer ones, and those that end in a space mark or hold characters that are no pieces, have an agenda of their own on a heap (``merge``).
    ``check`` compares new chunks with the library, batch by batch.
    """

    def __init__(self, path: str, check: bool = True, cache: int = CACHE):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("a merge-type vocabulary with identity normalisation and a leading space mark is needed")
        self.scores, self.ids, self.bytes, self.control = {}, {}, {}, set()
        self.text = [p.piece for p in proto.pieces]
        for i, p in enumerate(proto.pieces):
            if p.type == 1:
                self.scores[p.piece], self.ids[p.piece] = p.score, i
            elif p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
            elif p.type in (2, 3):
                self.control.add(i)
            else:
                raise ValueError("pieces of this type are not handled")
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.ids) or len(self.bytes) != 256:
            raise ValueError("pieces cross the places where texts are cut")
        order = {x: r for r, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.rank = {p: order[x] for p, x in self.scores.items()}
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.last_byte = max(self.byte_of)
        self.raw = [i.to_bytes(4, "little") for i in range(len(self.text))]
        self.shown = [t.replace(SPACE, " ") for t in self.text]
        self.bos, self.eos = self.lib.bos_id(), self.lib.eos_id()
        self.chunks, self.parts = Generations(cache), Generations(cache)
        self.check, self.fresh = check, []
        self._number_symbols()

    def _number_symbols(self) -> None:
        """Numbers of symbols (pieces and single characters), and a hash table from two numbers to that of the piece they join to."""
        singles = sorted({c for p in self.ids for c in p} - self.ids.keys())
        number = {p: n for n, p in enumerate([*self.ids, *singles])}
        self.none = len(number)  # no symbol: what stands beyond a chunk's ends, and characters in no piece
        self.id_of = np.array([*self.ids.values()] + [-1] * (len(singles) + 1), np.int64)
        self.rank_of = np.array([self.rank[p] for p in self.ids] + [-1] * (len(singles) + 1), np.int64)
        self.long = np.array([len(t) for t in self.shown])
        known = {ord(p): n for p, n in number.items() if len(p) == 1}
        self.symbol = np.full(max(known) + 2, self.none, np.int32)
        self.symbol[[*known]] = [*known.values()]
        found = {number[p[:i]] * (self.none + 1) + number[p[i:]]: number[p] for p in self.ids for i in range(1, len(p)) if p[:i] in number and p[i:] in number}
        self.slots = 2 + max(1, len(found)).bit_length()  # at most a quarter is taken
        self.pair_keys, self.pair_made = np.full(1 << self.slots, -1, np.int64), np.full(1 << self.slots, self.none, np.int32)
        keys, made = np.array([*found], np.int64), np.array([*found.values()], np.int32)
        at = self._slot(keys)
        while len(keys):
            one = np.zeros(len(keys), bool)
            one[np.unique(at, return_index=True)[1]] = True
            one &= self.pair_keys[at] < 0
            self.pair_keys[at[one]], self.pair_made[at[one]] = keys[one], made[one]
            keys, made, at = keys[~one], made[~one], at[~one] + 1 & (1 << self.slots) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.slots)).astype(np.int64)

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbols that pairs join to, ``none`` for those that are no piece."""
        keys = a.astype(np.int64) * (self.none + 1) + b
        at = self._slot(keys)
        held = self.pair_keys[at]
        out = np.where(held == keys, self.pair_made[at], self.none)
        live = np.flatnonzero((held != keys) & (held >= 0))
        while len(live):
            at[live] = at[live] + 1 & (1 << self.slots) - 1
            held = self.pair_keys[at[live]]
            hit = held == keys[live]
            out[live[hit]] = self.pair_made[at[live[hit]]]
            live = live[~hit & (held >= 0)]
        return out

    def merge(self, part: str) -> list[int]:
        """Identifiers of a part. The agenda holds rank of the score and place, so the best score comes first, then the leftmost place."""
        n, sym, get, push, pop = len(part), list(part), self.rank.get, heapq.heappush, heapq.heappop
        left, right, bits = list(range(-1, n - 1)), list(range(1, n + 1)), n.bit_length()
        pair = [part[i : i + 2] for i in range(n)]  # what the symbol at a place and the next one join to
        rank = [get(p) for p in pair]  # and its rank, None if it is no piece; the agenda's entries of another rank are out of date
        rank[-1] = None
        agenda = [r << bits | i for i, r in enumerate(rank) if r is not None]
        heapq.heapify(agenda)
        low = (1 << bits) - 1
        while agenda:
            best = pop(agenda)
            i = best & low
            if rank[i] != best >> bits:
                continue
            s, j = pair[i], right[i]
            sym[i], sym[j], rank[j] = s, "", None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                pair[i] = p = s + sym[k]
                rank[i] = r = get(p)
                if r is not None:
                    push(agenda, r << bits | i)
            else:
                rank[i] = None
            if (h := left[i]) >= 0:
                pair[h] = p = sym[h] + s
                rank[h] = r = get(p)
                if r is not None:
                    push(agenda, r << bits | h)
        out, ids = [], self.ids
        for s in sym:
            if s:
                i = ids.get(s)
                out += [i] if i is not None else [self.bytes[b] for b in s.encode()]
        return out

    def merge_many(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers, how many of each chunk) of chunks of known characters, given one after another as numbers.

        A chunk is a column: its symbols, the places of their neighbours to the left and right, and its agenda, which holds rank of the score and
        place of each pair as ``merge`` does. Each round pops the best entry of every column, joins that pair, and enters its two new neighbours.
        """
        n, wide = len(sizes), int(sizes.max())
        place = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        sym = np.full((wide + 1, n), self.none, np.int32)  # the last row is what lies beyond both ends
        sym[place, np.repeat(np.arange(n), sizes)] = symbols
        here = np.arange(wide + 1, dtype=np.int32)[:, None]
        right = np.where(here + 1 < sizes, here + 1, wide).astype(np.int32)
        left = np.repeat(np.where(here > 0, here - 1, wide).astype(np.int32), n, axis=1)
        bits, nothing = wide.bit_length(), np.iinfo(np.int32).max
        made, agenda = np.full((wide + 1, n), self.none, np.int32), np.full((wide + 1, n), nothing, np.int32)

        def enter(at: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            got = self._joined(a, b)
            made.reshape(-1)[at] = got
            agenda.reshape(-1)[at] = np.where(got == self.none, nothing, self.rank_of[got] << bits | at // n)

        first = np.flatnonzero(right[:-1].ravel() < wide)
        enter(first, sym.ravel()[first], sym.ravel()[first + n])
        sym_, right_, left_, made_, agenda_ = (x.reshape(-1) for x in (sym, right, left, made, agenda))
        while True:
            best = agenda.min(axis=0)
            c = np.flatnonzero(best != nothing)
            if not len(c):
                break
            i = (best[c] & (1 << bits) - 1) * n + c
            s, j = made_[i], right_[i] * n + c
            k = right_[j]
            sym_[i], sym_[j], agenda_[j], right_[i] = s, self.none, nothing, k
            k, h = k * n + c, left_[i] * n + c
            left_[k] = i // n
            enter(np.concatenate([i, h]), np.concatenate([s, sym_[h]]), np.concatenate([sym_[k], s]))
        got = self.id_of[sym[:-1].T]
        return got[got >= 0], (got >= 0).sum(axis=1)

    def plain(self, ids: list[int]) -> str:
        """The text of identifiers, the leading space mark still on; runs of byte pieces are read as UTF-8."""
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i is not None and i not in self.control:
                out.append(self.text[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        own = [i for i in ids if i not in self.control]
        text = self.plain(own)
        return text[1:] if own and self.text[own[0]].startswith(SPACE) else text

    def cut(self, chunk: str) -> list[str]:
        """No piece spans two neighbours that stand together in no piece: the chunk can be cut there."""
        out, at, pairs = [], 0, self.pairs
        for m in BORDER.finditer(chunk, 1):
            i = m.start()
            if chunk[i - 1 : i + 1] not in pairs:
                out.append(chunk[at:i])
                at = i
        return [*out, chunk[at:]]

    def keys(self, text: str | None) -> list[str]:
        """The chunks of a text, without the space mark that all but those after a line feed begin with."""
        if not text:
            return []
        if SPACE not in text:
            found = text.replace("\n", " \n").split(" ")
            if "" not in found:
                return found
        return [c if c[0] == "\n" else c[1:] for c in CHUNK.findall(SPACE + text.replace(" ", SPACE))]

    def code(self, chunk: str) -> tuple[bytes, str]:
        """Of a chunk: its identifiers as little-endian 32-bit integers, and their text. Its parts are merged one by one."""
        parts, ids = self.parts, []
        for p in self.cut(chunk):
            got = parts.young.get(p)
            if got is None and (got := parts.get(p)) is None:
                got = parts.put(p, self.merge(p))
            ids += got
        if self.check:
            self.fresh.append((chunk, np.array(ids, np.int64)))
        return b"".join([self.raw[i] for i in ids]), self.plain(ids)

    def codes(self, keys: list[str]) -> Iterator[tuple[str, tuple[bytes, str]]]:
        """Each key with what became of its chunk, as ``code`` gives it."""
        chunks = [k if k[:1] == "\n" else SPACE + k for k in keys]
        sizes = np.array([len(c) for c in chunks])
        symbols = self.symbol[np.minimum(np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32), len(self.symbol) - 1)]
        ends = np.cumsum(sizes)
        strange = np.append(0, np.cumsum(self.id_of[symbols] < 0))
        own = (sizes > SHORT) | (strange[ends] > strange[ends - sizes]) | np.array([c.endswith(SPACE) for c in chunks])
        for k in np.flatnonzero(own).tolist():
            yield keys[k], self.code(chunks[k])
        order = np.flatnonzero(~own)
        order = order[np.argsort(sizes[order], kind="stable")]
        for a in range(0, len(order), COLUMNS):
            some = order[a : a + COLUMNS]
            size = sizes[some]
            at = np.arange(int(size.sum())) + np.repeat(ends[some] - np.cumsum(size), size)
            ids, count = self.merge_many(symbols[at], size)
            if self.check:
                self.fresh.append(("".join([chunks[k] for k in some.tolist()]), ids))
            raw, shown = ids.astype("<u4").tobytes(), "".join(map(self.shown.__getitem__, ids.tolist()))
            upto = np.cumsum(count)
            text = np.append(0, np.cumsum(self.long[ids]))[np.append(0, upto)].tolist()
            b = t = 0
            for k, e, u in zip(some.tolist(), (4 * upto).tolist(), text[1:]):
                yield keys[k], (raw[b:e], shown[t:u])
                b, t = e, u

    def many(self, texts: list[str | None]) -> Iterator[tuple[bytes, int, str]]:
        """For each text: identifiers as little-endian 32-bit integers, their number, decoded text; with begin and end identifiers."""
        held, chunks, now, new = [self.keys(t) for t in texts], self.chunks, {}, []
        for k in set().union(*held):
            got = chunks.young.get(k)
            if got is None and (got := chunks.get(k)) is None:
                new.append(k)
            else:
                now[k] = got
        for k, got in self.codes(new) if new else ():
            now[k] = chunks.put(k, got)
        bos, eos = self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little")
        for h in held:
            codes, shown = zip(*map(now.__getitem__, h)) if h else ((), ())
            ids = b"".join([bos, *codes, eos])
            yield ids, len(ids) // 4, "".join(shown)[1:]

    def encode(self, text: str | None) -> tuple[bytes, int, str]:
        return next(iter([*self.many([text])]))

    def compare(self) -> None:
        """Hold the chunks first met in this batch against the library, many in one text, as no piece crosses them; a difference raises ValueError."""
        fresh, self.fresh = self.fresh, []
        lead = self.lib.encode("\n")  # the space mark that the library puts first, and what parts it from the chunk
        for run in slices_of(fresh):
            # a chunk that ends in a space mark only stands at a text's end or before a line feed
            text = "".join([c + "\n" if c.endswith(SPACE) else c for c, _ in run])
            ids = np.concatenate([x for c, i in run for x in ((i, lead[1:]) if c.endswith(SPACE) else (i,))])
            want = self.lib.encode("\n" + text)
            if want[: len(lead)] != lead or not np.array_equal(np.array(want[len(lead) :], np.int64), ids):
                raise ValueError(f"the library encodes {text[:80]!r} or what follows otherwise")


def slices_of(fresh: list[tuple[str, np.ndarray]], size: int = 100_000) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Runs of chunks of about ``size`` characters together."""
    run, held = [], 0
    for f in fresh:
        run.append(f)
        held += len(f[0])
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def loaded(path: str, check: bool, cache: int = CACHE) -> Pieces:
    """One vocabulary for each worker process: what it has learned serves the tasks that follow."""
    return kept(("pieces", path, check, cache), lambda: Pieces(path, check, cache))


def encode_decode(docs: DataFrame, path: str, check: bool = True) -> DataFrame:
    """Rows ``(doc_id, ids array<int>, decoded)`` with begin and end identifiers. Null text counts as empty."""

    @pandas_udf("ids array<int>, decoded string")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = loaded(path, check)
        for s in batches:
            with without_cycles():
                got = [g for run in slices(s) for g in pieces.many(run)]
                pieces.compare()
            yield pd.DataFrame({"ids": [np.frombuffer(g[0], "<u4").astype("int32") for g in got], "decoded": [g[2] for g in got]})

    return docs.select("doc_id", code("text").alias("c")).select("doc_id", "c.ids", "c.decoded")


def encoded_digests(docs: DataFrame, path: str, check: bool = True, cache: int = CACHE, together: int = 4_000_000) -> DataFrame:
    """Rows ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``. Null text counts as empty; rows are independent.

    ``cache``: how many chunks a worker remembers; ``together``: how many characters of texts (one text at least) it encodes
    and compares with the library at once. Less of either costs time and saves memory, and gives the same rows.
    """

    @pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = loaded(path, check, cache)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for s in batches:
            rows = []
            for run in slices(s, together):
                with without_cycles():
                    rows += [(g[1], sha(g[0]), sha(g[2].encode())) for g in pieces.many(run)]
                    pieces.compare()
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            give_back()

    return docs.select("doc_id", code("text").alias("c")).select("doc_id", "c.*")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
