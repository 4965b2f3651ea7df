"""Lossless WebP in NumPy: a writer, a full reader, and payloads of bytes kept as pixels.

The reader handles everything a lossless stream can hold: groups of prefix codes with an entropy image,
back-references with the near-pixel distance codes, the colour cache, and the predictor, cross-colour,
subtract-green and palette transforms. Streams without transforms under one group of short codes, which the writer mostly makes,
are read in lockstep: one pixel or copy of every image at each step, by table look-up. The writer takes whichever of the format's
steps shorten a tile: back-references, the colour cache, the palette, or subtract-green, predictor and cross-colour transforms.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
#: The places (columns left, rows up) that distance codes 1 to 120 name: the nearest first, then by columns, left before right.
NEAR = sorted(
    [(x, y) for y in range(8) for x in range(-8, 9) if (y > 0 and x > -8) or (y == 0 and x > 0)],
    key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0),
)
SHORT = 11  # bits of the longest code that is read in lockstep, and that the writer makes


class Bits:
    """Reads bits, lowest first."""

    def __init__(self, data: bytes):
        self.n, self.at, self.data = len(data) * 8, 0, data + bytes(16)

    def read(self, k: int) -> int:
        if self.at + k > self.n:
            raise ValueError("the stream ends too early")
        v = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 5], "little") >> (self.at & 7) & ((1 << k) - 1)
        self.at += k
        return v


_n = np.arange(1 << 15)
TURNED = sum((_n >> b & 1) << 14 - b for b in range(15))  # 15 bits in reverse


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with a code, shortest first; their lengths; their codes with the first bit lowest)."""
    sym = np.flatnonzero(lengths)
    sym = sym[np.argsort(lengths[sym], kind="stable")]
    size = lengths[sym].astype(np.int64)
    full = 15 - size
    start = np.cumsum(1 << full) - (1 << full)
    return sym, size, TURNED[start]


class Code:
    """A prefix code as a table over the next ``bits`` bits."""

    def __init__(self, lengths: list[int] | np.ndarray):
        lengths = np.asarray(lengths)
        sym, size, code = canonical(lengths)
        if not len(sym):
            raise ValueError("a prefix code without symbols")
        if len(sym) == 1:
            self.bits, self.symbols, self.sizes = 0, np.array([sym[0]], np.int64), np.zeros(1, np.int64)
            return
        if (1 << (15 - size)).sum() != 1 << 15:
            raise ValueError("an incomplete prefix code")
        self.bits = int(size[-1])
        n = 1 << (self.bits - size)
        at = np.repeat(code, n) + ((np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) << np.repeat(size, n))
        self.symbols, self.sizes = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int64)
        self.symbols[at], self.sizes[at] = np.repeat(sym, n), np.repeat(size, n)

    def read(self, b: Bits) -> int:
        v = int.from_bytes(b.data[b.at >> 3 : (b.at >> 3) + 4], "little") >> (b.at & 7) & ((1 << self.bits) - 1)
        b.at += int(self.sizes[v])
        return int(self.symbols[v])


@lru_cache(maxsize=2048)
def code_of(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.uint8))


def read_code(b: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if b.read(1):
        two, wide = b.read(1), b.read(1)
        first = b.read(8 if wide else 1)
        lengths[first] = 1
        if two:
            lengths[b.read(8)] = 1
        return code_of(bytes(lengths).rstrip(b"\0"))
    sizes = [0] * 19
    for k in range(4 + b.read(4)):
        sizes[LENGTH_ORDER[k]] = b.read(3)
    code = code_of(bytes(sizes).rstrip(b"\0"))
    left = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(b)
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
        else:
            n, v = {16: lambda: (3 + b.read(2), last), 17: lambda: (3 + b.read(3), 0), 18: lambda: (11 + b.read(7), 0)}[s]()
            if at + n > alphabet:
                raise ValueError("code lengths run over")
            lengths[at : at + n] = [v] * n
            at += n
    return code_of(bytes(lengths).rstrip(b"\0"))


def read_codes(b: Bits, green: int) -> list[Code]:
    """The five codes of a group. A description that comes again bit by bit is not read again."""
    begin = b.at
    codes = [read_code(b, green)]
    size = b.at - begin
    text = int.from_bytes(b.data[begin >> 3 : (begin + 3 * size + 7 >> 3) + 1], "little") >> (begin & 7)
    same = codes[0].symbols.max() < 256
    for k in (1, 2):
        if same and text >> k * size & (1 << size) - 1 == text & (1 << size) - 1 and b.at == begin + k * size:
            codes.append(codes[0])
            b.at += size
        else:
            codes.append(read_code(b, 256))
    return codes + [read_code(b, n) for n in (256, 40)]


def _extended(b: Bits, s: int) -> int:
    if s < 4:
        return s + 1
    k = (s - 2) >> 1
    return ((2 + (s & 1)) << k) + b.read(k) + 1


def read_pixels(b: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers."""
    cache_bits = b.read(4) if b.read(1) else 0
    groups, meta, shift = 1, None, 0
    if main and b.read(1):
        shift = b.read(3) + 2
        across = -(-width >> shift)
        meta = (read_pixels(b, across, -(-height >> shift), False) >> 8 & 0xFFFF).reshape(-1, across)
        groups = int(meta.max()) + 1
    codes = [[read_code(b, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    n = width * height
    out = np.zeros(n, np.int64)
    cache = [0] * (1 << cache_bits)
    at = 0
    while at < n:
        own = codes[int(meta[(at // width) >> shift, (at % width) >> shift]) if meta is not None else 0]
        s = own[0].read(b)
        if s < 256:
            red, blue, alpha = own[1].read(b), own[2].read(b), own[3].read(b)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            made = 1
        elif s < 280:
            made = _extended(b, s - 256)
            d = _extended(b, own[4].read(b))
            if d <= 120:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            else:
                d -= 120
            if d > at or at + made > n:
                raise ValueError("a back-reference leaves the image")
            for k in range(at, at + made):
                out[k] = out[k - d]
        else:
            out[at] = cache[s - 280]
            made = 1
        if b.at > b.n:
            raise ValueError("the stream ends too early")
        if cache_bits:
            for p in out[at : at + made].tolist():
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        at += made
    return out


def split(argb: np.ndarray) -> np.ndarray:
    """ARGB numbers as (..., 4) channels alpha, red, green, blue."""
    return (argb[..., None] >> np.array([24, 16, 8, 0])) & 255


def join(c: np.ndarray) -> np.ndarray:
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predict(mode: int, left, top, right, corner) -> list[int]:
    """The prediction from the pixels to the left, above, above right and above left."""
    mean = lambda a, c: [(x + y) >> 1 for x, y in zip(a, c)]
    if mode == 11:
        near = sum(abs(t - c) - abs(l - c) for l, t, c in zip(left, top, corner))
        return left if near < 0 else top
    if mode == 12:
        return [min(255, max(0, l + t - c)) for l, t, c in zip(left, top, corner)]
    if mode == 13:
        return [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(mean(left, top), corner)]
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner,
        5: lambda: mean(mean(left, right), top), 6: lambda: mean(left, corner), 7: lambda: mean(left, top),
        8: lambda: mean(corner, top), 9: lambda: mean(top, right), 10: lambda: mean(mean(left, corner), mean(top, right)),
    }.get(mode, lambda: [255, 0, 0, 0])()


def undo_predictor(px: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """Add the predictions back; px has the rows of channels, modes one number for each block."""
    height, width, _ = px.shape
    rows = px.tolist()
    for y in range(height):
        for x in range(width):
            if y == 0:
                p = rows[0][x - 1] if x else [255, 0, 0, 0]
            elif x == 0:
                p = rows[y - 1][0]
            else:
                p = _predict(int(modes[y >> shift, x >> shift]), rows[y][x - 1], rows[y - 1][x], rows[y - 1][x + 1] if x + 1 < width else rows[y][0], rows[y - 1][x - 1])
            rows[y][x] = [(a + b) & 255 for a, b in zip(rows[y][x], p)]
    return np.array(rows)


def undo_cross_colour(px: np.ndarray, factors: np.ndarray, shift: int) -> np.ndarray:
    """factors: channels of the transform image; its blue, green and red hold green to red, green to blue, red to blue."""
    signed = lambda a: (a ^ 128) - 128
    f = signed(factors[np.arange(px.shape[0]) >> shift][:, np.arange(px.shape[1]) >> shift])
    green = signed(px[..., 2])
    red = (px[..., 1] + (f[..., 3] * green >> 5)) & 255
    blue = (px[..., 3] + (f[..., 2] * green >> 5) + (f[..., 1] * signed(red) >> 5)) & 255
    return np.stack([px[..., 0], red, px[..., 2], blue], -1)


def read_webp(data: bytes) -> np.ndarray:
    """Rows of (alpha, red, green, blue) of one lossless WebP file. Raises ValueError for anything else."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or data[12:16] != b"VP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    b = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = b.read(14) + 1, b.read(14) + 1
    if b.read(4) >> 1:
        raise ValueError("an unknown version")
    undo, wide = [], width
    while b.read(1):
        kind = b.read(2)
        if kind in (0, 1):
            shift = b.read(3) + 2
            across, down = -(-wide >> shift), -(-height >> shift)
            image = read_pixels(b, across, down, False).reshape(down, across)
            undo.append((kind, shift, (image >> 8 & 15) if kind == 0 else split(image), wide))
        elif kind == 3:
            size = b.read(8) + 1
            table = np.cumsum(split(read_pixels(b, size, 1, False)), axis=0) & 255
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((3, pack, np.concatenate([table, np.zeros((256, 4), np.int64)]), wide))
            wide = -(-wide >> pack)
        else:
            undo.append((2, 0, None, wide))
    px = split(read_pixels(b, wide, height, True).reshape(height, wide))
    for kind, shift, more, before in reversed(undo):
        if kind == 0:
            px = undo_predictor(px, more, shift)
        elif kind == 1:
            px = undo_cross_colour(px, more, shift)
        elif kind == 2:
            px = np.stack([px[..., 0], px[..., 1] + px[..., 2] & 255, px[..., 2], px[..., 3] + px[..., 2] & 255], -1)
        else:
            x = np.arange(before)
            bits = 8 >> shift
            index = px[..., 2][:, x >> shift] >> (x & ((1 << shift) - 1)) * bits & ((1 << bits) - 1)
            px = more[index]
    return px


def code_lengths(counts: list[int], most: int) -> list[int]:
    """Lengths of a prefix code for the counts, none over ``most`` bits."""
    while True:
        n = first = len(counts)
        heap = [c << 16 | s for s, c in enumerate(counts) if c]
        heapq.heapify(heap)
        up = [0] * (2 * n)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            up[a & 0xFFFF] = up[b & 0xFFFF] = n
            heapq.heapreplace(heap, (a >> 16) + (b >> 16) << 16 | n)
            n += 1
        depth = [0] * n
        for s in range(n - 2, first - 1, -1):
            depth[s] = depth[up[s]] + 1
        lengths = [depth[up[s]] + 1 if c and n > first else 0 for s, c in enumerate(counts)]
        if max(lengths) <= most:
            return lengths
        counts = [c // 2 + 1 if c else 0 for c in counts]


def _code_bits(lengths: list[int]) -> tuple[int, int]:
    """A prefix code as the stream holds it: (bits as a number, how many)."""
    used = [s for s, k in enumerate(lengths) if k]
    if len(used) == 1:
        return 0b101 | used[0] << 3, 11
    ends = used[-1] + 1
    items: list[tuple[int, int, int]] = []  # symbol, extra value, its bits
    at = 0
    while at < ends:
        if lengths[at]:
            items.append((lengths[at], 0, 0))
            at += 1
            continue
        run = 1
        while lengths[at + run] == 0:
            run += 1
        at += run
        while run:
            k = min(run, 138)
            items.append((18, k - 11, 7) if k >= 11 else (17, k - 3, 3) if k >= 3 else (0, 0, 0))
            run -= k if k >= 3 else 1
    counts = [0] * 19
    for s, _, _ in items:
        counts[s] += 1
    if sum(c > 0 for c in counts) == 1:
        counts[0 if counts[0] == 0 else 1] += 1  # two symbols make the code complete
    sizes = code_lengths(counts, 7)
    sym, size, code = canonical(np.array(sizes))
    of = {s: (c, k) for s, k, c in zip(sym.tolist(), size.tolist(), code.tolist())}
    v, n = 0, 1  # the first bit: not a simple code

    def put(x: int, k: int) -> None:
        nonlocal v, n
        v |= x << n
        n += k

    last = max(k for k in range(19) if sizes[LENGTH_ORDER[k]]) + 1
    put(max(0, last - 4), 4)
    for k in range(max(4, last)):
        put(sizes[LENGTH_ORDER[k]], 3)
    put(1, 1)
    put(4, 3)  # the number of items in 10 bits
    put(len(items) - 2, 10)
    for s, x, k in items:
        put(*of[s])
        put(x, k)
    return v, n


WIDTH, ROWS = 64, 64
TILE = 3 * WIDTH * ROWS


DISTANCE_CODE = np.arange(TILE // 3 + 1) + 120
for _k, (_x, _y) in reversed(list(enumerate(NEAR))):  # the nearest name of a distance
    if 0 < _x + _y * WIDTH < len(DISTANCE_CODE):
        DISTANCE_CODE[_x + _y * WIDTH] = _k + 1


def _wrapped(stream: bytes) -> bytes:
    data = b"\x2f" + stream
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + (12 + len(data) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + pad


def _prefixed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths or distance codes as (symbol, extra value, its bits)."""
    x = v - 1
    high = np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
    k = np.maximum(high - 1, 0)
    return np.where(x < 4, x, 2 * high + (x >> k & 1)), np.where(x < 4, 0, x & (1 << k) - 1), np.where(x < 4, 0, k)


def find_references(tiles: list[bytes], least: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """For each tile: where its tokens start, how many pixels each stands for, and how far back a copy reads (0: a literal).

    None for a tile where fewer than ``least`` pixels stand in any three that were there before.
    """
    flat = np.frombuffer(b"".join(tiles), np.uint8).reshape(-1, 3).astype(np.uint64)
    sizes = np.array([len(t) // 3 for t in tiles])
    p = flat[:, 0] << np.uint64(16) | flat[:, 1] << np.uint64(8) | flat[:, 2]
    of = np.repeat(np.arange(len(tiles)), sizes)
    key = p[:-2] * np.uint64(0x9E3779B97F4A7C15) + p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + p[2:] * np.uint64(0x165667B19E3779F9) + of[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(key, kind="stable")
    now, was = order[1:], order[:-1]
    equal = key[order]
    alike = np.flatnonzero(equal[1:] == equal[:-1])
    now, was = now[alike], was[alike]
    same = of[was] == of[now + 2]
    for k in range(3):
        same &= p[now + k] == p[was + k]
    now, was = now[same], was[same]
    back = np.zeros(len(p), np.int64)
    back[now] = now - was
    covered = np.zeros(len(p), bool)
    for k in range(3):
        covered[now + k] = True
    ends = np.cumsum(sizes)
    count = np.diff(np.append(0, np.cumsum(covered)[ends - 1]))
    for k, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
        if count[k] < least[k]:
            yield None
            continue
        far = back[end - size : end]
        last = np.append(np.flatnonzero(far[1:] != far[:-1]), size - 1)  # where runs of one distance end
        # a run never leaves its tile: its last place has two more pixels there
        made = np.where(far > 0, last[np.searchsorted(last, np.arange(size))] - np.arange(size) + 3, 1)
        steps, starts, at = made.tolist(), [], 0
        while at < size:
            starts.append(at)
            at += steps[at]
        some = np.array(starts)
        yield some, made[some], far[some]


def _header(height: int) -> list[tuple[int, int]]:
    return [((WIDTH - 1) | (height - 1) << 14, 32)]  # no alpha, version 0


def _bits_of(parts: list[tuple[int, int]]) -> np.ndarray:
    v = n = 0
    for x, k in parts:
        v, n = v | x << n, n + k
    return np.unpackbits(np.frombuffer(v.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n]


def _coded(argb: np.ndarray, made: np.ndarray | None = None, back: np.ndarray | None = None, cached: np.ndarray | None = None, main: bool = True) -> np.ndarray:
    """The bits of an entropy-coded image under one group of codes: a row of alpha, red, green, blue for each token.

    ``made`` and ``back``: pixels and distance of copies (distance 0: none). ``cached``: places in the colour cache (negative: none).
    """
    n = len(argb)
    copy = np.zeros(n, bool) if back is None else back > 0
    held = np.zeros(n, bool) if cached is None else cached >= 0
    length, more, more_bits = _prefixed(np.where(copy, 1 if made is None else made, 1))
    far, rest, rest_bits = _prefixed(DISTANCE_CODE[np.where(copy, 0 if back is None else back, 1)])
    green = np.where(copy, 256 + length, np.where(held, 280 + (0 if cached is None else cached), argb[:, 2]))
    literal = ~copy & ~held
    values, sizes = np.zeros((n, 5), np.int64), np.zeros((n, 5), np.int64)
    head = [(0, 1)] if cached is None else [(1 | CACHE_BITS << 1, 5)]
    head += [(0, 1)] * main  # one group
    # the extra bits of a length follow its symbol, those of a distance come last
    for symbols, alphabet, column, where in (
        (green, 280 + (0 if cached is None else 1 << CACHE_BITS), 0, None), (argb[:, 1], 256, 1, literal), (argb[:, 3], 256, 2, literal), (argb[:, 0], 256, 3, literal), (far, 40, 2, copy),
    ):
        at = np.arange(n) if where is None else np.flatnonzero(where)
        symbols = symbols[at]
        counts = np.bincount(symbols, minlength=alphabet).tolist()
        if sum(c > 0 for c in counts) > 1:
            lengths = code_lengths(counts, SHORT)
            sym, some, bits = canonical(np.array(lengths))
            code, size = np.zeros(alphabet, np.int64), np.zeros(alphabet, np.int64)
            code[sym], size[sym] = bits, some
            values[at, column], sizes[at, column] = code[symbols], size[symbols]
        else:
            lengths = [0] * alphabet
            lengths[int(symbols[0]) if len(symbols) else 0] = 1
            if len(symbols) and symbols[0] > 255:  # too large for a simple code, so a second one stands beside it
                lengths[0] = 1
                values[at, column], sizes[at, column] = 1, 1
        head.append(_code_bits(lengths))
    values[copy, 1], sizes[copy, 1] = more[copy], more_bits[copy]
    values[copy, 3], sizes[copy, 3] = rest[copy], rest_bits[copy]
    c, k = values.ravel(), sizes.ravel()
    within = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    return np.concatenate([_bits_of(head), (np.repeat(c, k) >> within & 1).astype(np.uint8)])


def _file(*bits: np.ndarray) -> bytes:
    return _wrapped(np.packbits(np.concatenate(bits), bitorder="little").tobytes())


def _argb(tile: bytes) -> np.ndarray:
    rgb = np.frombuffer(tile, np.uint8).reshape(-1, 3).astype(np.int64)
    return np.concatenate([np.full((len(rgb), 1), 255), rgb], axis=1)


def _write_referenced(tile: bytes, starts: np.ndarray, made: np.ndarray, back: np.ndarray) -> bytes:
    """The file of a tile with back-references: codes of their own for green and lengths, red, blue, and distances."""
    return _file(_bits_of([*_header(len(tile) // (3 * WIDTH)), (0, 1)]), _coded(_argb(tile)[starts], made, back))


CACHE_BITS = 8


def cache_places(argb: np.ndarray) -> np.ndarray:
    return (CACHE_FACTOR * argb & 0xFFFFFFFF) >> 32 - CACHE_BITS


def _write_cached(tile: bytes) -> bytes:
    """The file of a tile whose pixels stand as places in the colour cache where it holds them."""
    argb = _argb(tile)
    p = join(argb)
    place = cache_places(p)
    order = np.argsort(place, kind="stable")
    held = np.zeros(len(p), bool)
    held[order[1:]] = (place[order[1:]] == place[order[:-1]]) & (p[order[1:]] == p[order[:-1]])
    return _file(_bits_of([*_header(len(tile) // (3 * WIDTH)), (0, 1)]), _coded(argb, cached=np.where(held, place, -1)))


def _write_palette(tile: bytes) -> bytes | None:
    """The file of a tile of at most 256 colours as places in a palette, several in a pixel if there are 16 or fewer."""
    argb = _argb(tile)
    colours, index = np.unique(join(argb), return_inverse=True)
    if len(colours) > 256:
        return None
    table = split(colours)
    table[1:] = table[1:] - table[:-1] & 255
    pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
    green = (index.reshape(-1, WIDTH >> pack, 1 << pack) << np.arange(1 << pack) * (8 >> pack)).sum(axis=2).ravel()
    px = np.zeros((len(green), 4), np.int64)
    px[:, 0], px[:, 2] = 255, green
    return _file(_bits_of([*_header(len(tile) // (3 * WIDTH)), (0b111 | len(colours) - 1 << 3, 11)]), _coded(table, main=False), np.zeros(1, np.uint8), _coded(px))


def predicted(px: np.ndarray) -> np.ndarray:
    """What each of the modes 0 to 13 predicts from the rows of channels ``px``; the first row and column have fixed modes."""
    height, width, _ = px.shape
    black = np.array([255, 0, 0, 0])
    left, top, right, corner = (np.zeros_like(px) for _ in range(4))
    left[:, 1:], top[1:], corner[1:, 1:] = px[:, :-1], px[:-1], px[:-1, :-1]
    right[1:, :-1], right[1:, -1] = px[:-1, 1:], px[1:, 0]
    mean = lambda a, c: a + c >> 1
    both = mean(left, top)
    half = both - corner
    near = (np.abs(top - corner) - np.abs(left - corner)).sum(axis=2, keepdims=True)
    out = np.stack([
        np.broadcast_to(black, px.shape), left, top, right, corner, mean(mean(left, right), top), mean(left, corner), both, mean(corner, top), mean(top, right),
        mean(mean(left, corner), mean(top, right)), np.where(near < 0, left, top), np.clip(left + top - corner, 0, 255), np.clip(both + (half + (half < 0) >> 1), 0, 255),
    ])
    out[:, 0], out[:, :, 0] = left[0], top[:, 0]
    out[:, 0, 0] = black
    return out


def _write_transformed(tile: bytes, green: bool, predictor: bool, cross: bool, shift: int = 3) -> bytes:
    """The file of a tile after subtract-green, the predictor of each block of pixels that leaves least, and cross-colour factors of the whole tile."""
    px = _argb(tile).reshape(-1, WIDTH, 4)
    height = len(px)
    bits = [_bits_of(_header(height))]
    if green:
        bits.append(_bits_of([(0b101, 3)]))
        px = np.stack([px[..., 0], px[..., 1] - px[..., 2] & 255, px[..., 2], px[..., 3] - px[..., 2] & 255], -1)
    if predictor:
        left = px - predicted(px) & 255
        cost = np.minimum(left, 256 - left).sum(axis=3)
        cost = np.add.reduceat(np.add.reduceat(cost, np.arange(0, height, 1 << shift), axis=1), np.arange(0, WIDTH, 1 << shift), axis=2)
        modes = cost.argmin(axis=0)
        own = modes[np.arange(height) >> shift][:, np.arange(WIDTH) >> shift]
        px = np.take_along_axis(left, own[None, ..., None], axis=0)[0]
        image = np.zeros((modes.size, 4), np.int64)
        image[:, 0], image[:, 2] = 255, modes.ravel()
        bits += [_bits_of([(0b001 | shift - 2 << 3, 6)]), _coded(image, main=False)]
    if cross:
        r, g, b = ((px[..., k] ^ 128) - 128 for k in (1, 2, 3))
        slope = lambda y, x: int(np.clip(np.rint(32 * (y * x).sum() / max(1, (x * x).sum())), -128, 127))
        to_red, to_blue = slope(r, g), slope(b, g)
        rest = (b - (to_blue * g >> 5) & 255 ^ 128) - 128
        red_to_blue = slope(rest, r)
        px = np.stack([px[..., 0], r - (to_red * g >> 5) & 255, px[..., 2], b - (to_blue * g >> 5) - (red_to_blue * r >> 5) & 255], -1)
        bits += [_bits_of([(0b011 | 4 << 3, 6)]), _coded(np.array([[255, red_to_blue & 255, to_blue & 255, to_red & 255]]), main=False)]
    return _file(*bits, np.zeros(1, np.uint8), _coded(px.reshape(-1, 4)))


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits that the symbols counted in each row take at least."""
    total = counts.sum(axis=1)
    c = np.maximum(counts, 1)
    return total * np.log2(np.maximum(total, 1)) - (counts * np.log2(c)).sum(axis=1)


def expected_bits(tiles: list[bytes]) -> dict[str, np.ndarray]:
    """About what each tile takes in bits with the colour cache, with a palette, and with each transform in its plainest form."""
    sizes = np.array([len(t) // 3 for t in tiles])
    n = len(tiles)
    flat = np.frombuffer(b"".join(tiles), np.uint8).reshape(-1, 3)
    of = np.repeat(np.arange(n), sizes)
    red, green, blue = (np.ascontiguousarray(flat[:, k]) for k in range(3))
    p = red.astype(np.int64) << 16 | green.astype(np.int64) << 8 | blue
    place = cache_places(p | 0xFF000000)
    base = of * 256
    order = np.argsort((base + place).astype(np.uint16 if n <= 256 else np.int64), kind="stable")
    held = np.zeros(len(p), bool)
    held[order[1:]] = (p[order[1:]] == p[order[:-1]]) & (place[order[1:]] == place[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    count = lambda at, k=256: np.bincount(at, minlength=n * k).reshape(n, k)
    apart, one = [count(base + x) for x in (red, green, blue)], ~held
    hits, places = count((base + place)[held]), count(base + place)
    some = [count(base[one] + x[one]) for x in (red, green, blue)]
    kinds = (places > 0).sum(axis=1)
    out = {
        "cache": _entropy(np.concatenate([some[1], hits], axis=1)) + _entropy(some[0]) + _entropy(some[2]) + 4 * (hits > 0).sum(axis=1) + 900,
        "palette": np.where(kinds <= 200, _entropy(places) + 20 * kinds + np.where(kinds <= 16, 500, 1200), np.inf),
    }
    first = np.cumsum(sizes) - sizes
    signed = [x.view(np.int8).astype(np.int64) for x in (red, green, blue)]
    square = np.maximum(1, np.add.reduceat(signed[1] ** 2, first))
    slopes = [np.clip(np.rint(32 * np.add.reduceat(x * signed[1], first) / square), -128, 127).astype(np.int64)[of] for x in (signed[0], signed[2])]
    alone = lambda x, d: np.concatenate([x[:d], x[d:] - x[:-d]])
    for name, made in (
        ("green", (red - green, green, blue - green)), ("left", [alone(x, 1) for x in (red, green, blue)]), ("top", [alone(x, WIDTH) for x in (red, green, blue)]),
        ("cross", (red - (slopes[0] * signed[1] >> 5).astype(np.uint8), green, blue - (slopes[1] * signed[1] >> 5).astype(np.uint8))),
    ):
        out[name] = sum(_entropy(apart[1] if x is green else count(base + x)) for x in made) + 700
    return out


def write_tiles(tiles: list[bytes], worth: int = 8) -> list[bytes]:
    """The shortest file of each tile: literals under one code, or what back-references, the colour cache, a palette or transforms make of it.

    These are packed only where they are expected to save a ``worth``-th of the file, as packing and following them takes time.
    """
    files = write_literals(tiles)
    if not tiles:
        return files
    most = [len(f) * 8 - len(f) * 8 // worth for f in files]
    expected = expected_bits(tiles)
    for k, found in enumerate(find_references(tiles, [(len(f) * 8 // worth + 600) // 13 for f in files])):
        tile, made = tiles[k], []
        if found is not None:
            starts, sizes, back = found
            copies = back > 0
            # about what the copied pixels, the copies and three more codes take in bits
            if (int(sizes[copies].sum()) * 13 - int(copies.sum()) * 18 - 600) * worth > len(files[k]) * 8:
                made.append(_write_referenced(tile, starts, sizes, back))
        bound = min([most[k], *(len(m) * 8 for m in made)])
        if expected["cache"][k] < bound:
            made.append(_write_cached(tile))
        if expected["palette"][k] < min(bound, expected["cache"][k]) and (file := _write_palette(tile)):
            made.append(file)
        green, near, cross = (min(expected[x][k] for x in names) < bound for names in (("green",), ("left", "top"), ("cross",)))
        made += [_write_transformed(tile, *steps) for go, *steps in ((green, 1, 0, 0), (near, 0, 1, 0), (cross, 0, 0, 1), (near and green, 1, 1, 0), (near and cross, 0, 1, 1)) if go]
        files[k] = min(files[k], *made, key=len) if made else files[k]
    return files


def write_literals(tiles: list[bytes]) -> list[bytes]:
    """A WebP file for each run of bytes: 64 pixels a row, red, green and blue from three bytes each. Lengths: multiples of 192, 12,288 at most."""
    sizes = np.array([len(t) for t in tiles])
    flat = np.frombuffer(b"".join(tiles), np.uint8)
    of = np.repeat(np.arange(len(tiles)), sizes)
    counts = np.bincount(of * 256 + flat, minlength=256 * len(tiles)).reshape(-1, 256)
    codes, lens = np.zeros((len(tiles), 256), np.int64), np.zeros((len(tiles), 256), np.int64)
    heads = []
    for k, row in enumerate(counts.tolist()):
        lengths = code_lengths(row, SHORT)
        if sum(c > 0 for c in row) > 1:
            sym, size, code = canonical(np.array(lengths))
            codes[k, sym], lens[k, sym] = code, size
        else:
            lengths[next(s for s, c in enumerate(row) if c)] = 1
        one, bits = _code_bits(lengths)
        # width and height less 1, no alpha, version 0; no transform, no colour cache, one group; green, red, blue; alpha 255; distance 0
        v, n = (WIDTH - 1) | (int(sizes[k]) // (3 * WIDTH) - 1) << 14, 32 + 3
        for _ in range(3):
            v |= one << n
            n += bits
        v |= (0b101 | 255 << 3) << n | 0b001 << n + 11
        heads.append((v, n + 11 + 4))
    of, flat = of[::3] * 256, flat.reshape(-1, 3)
    c, k = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    for channel in (1, 0, 2):  # the three codes of a pixel as one, 33 bits at most
        at = of + flat[:, channel]
        c |= codes.ravel()[at] << k
        k += lens.ravel()[at]
    head_bits = np.array([n for _, n in heads])
    ends = np.cumsum(k)
    upto = np.append(0, ends)[np.append(0, np.cumsum(sizes // 3))]
    body = np.diff(upto)
    nbytes = (head_bits + body + 7) // 8
    base = np.cumsum(nbytes) - nbytes
    at = ends - k + np.repeat(base * 8 + head_bits - upto[:-1], sizes // 3)
    # Pixels that begin in the same 16 bits share no bit, so their sum (exact, as below 2 ** 53) holds them all.
    some = np.bincount(at >> 4, c << (at & 15), int(nbytes.sum()) // 2 + 4).astype(np.int64)
    words = some & 0xFFFF
    for j in (1, 2, 3):
        words[j:] += some[:-j] >> 16 * j & 0xFFFF
    packed = words.astype("<u2").view(np.uint8)
    for (v, n), a in zip(heads, base.tolist()):
        packed[a : a + (n + 7) // 8] |= np.frombuffer(v.to_bytes((n + 7) // 8, "little"), np.uint8)
    packed = packed.tobytes()
    return [_wrapped(packed[a : a + n]) for a, n in zip(base.tolist(), nbytes.tolist())]


def _read_referenced(files: list[bytes], some: list[tuple]) -> Iterator[np.ndarray]:
    """Streams with back-references in lockstep: one token of every image at each step, then all copies are traced to literals."""
    n = len(some)
    raw = np.frombuffer(b"".join(files[k][21:] + bytes(16) for _, k, _, _ in some) + bytes(16), np.uint8)
    base = np.cumsum([0] + [len(files[k]) - 5 for _, k, _, _ in some])[:-1] * 8
    ends = base + np.array([(len(files[k]) - 21) * 8 for _, k, _, _ in some])
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))).view("<u8").ravel()
    tables = np.zeros((4, n, 1 << SHORT), np.uint16)
    for i, (_, _, _, codes) in enumerate(some):
        for j, c in enumerate((codes[0], codes[1], codes[2], codes[4])):
            tables[j, i] = np.tile((c.symbols | c.sizes << 9).astype(np.uint16), 1 << (SHORT - c.bits))
    tables = tables.reshape(4, -1)
    mask = np.uint64((1 << SHORT) - 1)
    named = np.array([0] + [max(1, x + y * WIDTH) for x, y in NEAR])
    px = np.array([p[0] for p in some])
    first = np.cumsum(px) - px
    colour, source = np.zeros((int(px.sum()), 3), np.uint8), np.arange(int(px.sum()))
    at, pos, live = base + np.array([p[2] for p in some]), np.zeros(n, np.int64), np.arange(n)

    def extended(s, w):
        k = np.where(s < 4, 0, (s - 2) >> 1)
        bits = (w & ((np.uint64(1) << k.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        return np.where(s < 4, s + 1, ((2 + (s & 1)) << k) + bits + 1), k

    copies = []
    while len(live):
        p = at[live]
        w = words[p >> 3] >> (p & 7).astype(np.uint64)
        t = tables[0][(live << SHORT) + (w & mask).astype(np.int64)]
        s, used = (t & 511).astype(np.int64), (t >> 9).astype(np.int64)
        w >>= used.astype(np.uint64)
        made = np.ones(len(live), np.int64)
        lit, ref = np.flatnonzero(s < 256), np.flatnonzero(s >= 256)
        if len(lit):
            i, v = live[lit], w[lit]
            red = tables[1][(i << SHORT) + (v & mask).astype(np.int64)]
            v = v >> (red >> 9).astype(np.uint64)
            blue = tables[2][(i << SHORT) + (v & mask).astype(np.int64)]
            used[lit] += (red >> 9).astype(np.int64) + (blue >> 9)
            colour[first[i] + pos[i]] = np.stack([red & 255, s[lit] & 255, blue & 255], -1)
        if len(ref):
            i, v = live[ref], w[ref]
            made[ref], k = extended(s[ref] - 256, v)
            v = v >> k.astype(np.uint64)
            far = tables[3][(i << SHORT) + (v & mask).astype(np.int64)]
            v = v >> (far >> 9).astype(np.uint64)
            d, more = extended((far & 511).astype(np.int64), v)
            d = np.where(d <= 120, named[np.minimum(d, 120)], d - 120)
            used[ref] += k + (far >> 9) + more
            if (d > pos[i]).any() or (pos[i] + made[ref] > px[i]).any():
                raise ValueError("a back-reference leaves the image")
            copies.append((first[i] + pos[i], made[ref], d))
        at[live] = p + used
        if (at[live] > ends[live]).any():
            raise ValueError("the stream ends too early")
        pos[live] += made
        live = live[pos[live] < px[live]]
    begin, made, d = (np.concatenate(x) for x in zip(*copies))
    where = np.repeat(begin - (np.cumsum(made) - made), made) + np.arange(int(made.sum()))
    source[where] = where - np.repeat(d, made)
    while (source[source[where]] != source[where]).any():
        source[where] = source[source[where]]
    colour = colour[source]
    for a, size in zip(first.tolist(), px.tolist()):
        yield colour[a : a + size].ravel()


def _read_cached(files: list[bytes], some: list[tuple]) -> Iterator[np.ndarray]:
    """Streams of literals and places in the colour cache in lockstep, the largest images first: one pixel of every image at each step."""
    n = len(some)
    raw = np.frombuffer(b"".join(files[k][21:] + bytes(16) for _, k, _, _ in some) + bytes(16), np.uint8)
    base = np.cumsum([0] + [len(files[k]) - 5 for _, k, _, _ in some])[:-1] * 8
    ends = base + np.array([(len(files[k]) - 21) * 8 for _, k, _, _ in some])
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))).view("<u8").ravel()
    tables = np.concatenate([np.tile(c.symbols | c.sizes << 10, 1 << (SHORT - c.bits)) for j in range(3) for _, _, _, codes in some for c in codes[j : j + 1]]).reshape(3, -1)
    mask = np.uint64((1 << SHORT) - 1)
    px = np.array([p[0] for p in some])
    at, row = base + np.array([p[2] for p in some]), np.arange(n)
    cache, got = np.zeros((n, 1 << CACHE_BITS), np.int64), np.zeros((int(px[0]), n), np.int64)
    for step, m in enumerate(np.searchsorted(-px, -np.arange(int(px[0])), side="left").tolist()):
        i, p = row[:m], at[:m]
        w = words[p >> 3] >> (p & 7).astype(np.uint64)
        found = []
        for j in range(3):
            t = tables[j][(i << SHORT) + (w & mask).astype(np.int64)]
            w >>= (t >> 10).astype(np.uint64)
            found.append(t)
        (s, red, blue), size = (t & 1023 for t in found), [t >> 10 for t in found]
        literal = s < 256
        colour = np.where(literal, 0xFF000000 | red << 16 | s << 8 | blue, cache[i, np.maximum(s - 280, 0)])
        cache[i, cache_places(colour)] = colour
        got[step, :m] = colour
        p += size[0] + np.where(literal, size[1] + size[2], 0)
        if (p > ends[:m]).any():
            raise ValueError("the stream ends too early")
    for i, count in enumerate(px.tolist()):
        yield split(got[:count, i])[:, 1:].astype(np.uint8).ravel()


def read_tiles(files: list[bytes]) -> list[np.ndarray]:
    """The red, green, blue bytes of each file. Streams without transforms and cache are read in lockstep, all others one by one."""
    out: list[np.ndarray | None] = [None] * len(files)
    plain, referenced, held = [], [], []
    for k, f in enumerate(files):
        b = Bits(f[21 : 20 + int.from_bytes(f[16:20], "little")])
        if f[:4] == b"RIFF" and f[8:16] == b"WEBPVP8L" and f[20:21] == b"\x2f":
            w, h, version = b.read(14) + 1, b.read(14) + 1, b.read(4) >> 1
            bits = 0
            if version == 0 and b.read(1) == 0 and (b.read(1) == 0 or (bits := b.read(4)) == CACHE_BITS) and b.read(1) == 0:
                codes = read_codes(b, 280 + (1 << bits if bits else 0))
                if bits:
                    symbols = codes[0].symbols
                    if max(c.bits for c in codes[:3]) <= SHORT and codes[3].bits == 0 and codes[3].symbols[0] == 255 and not ((symbols > 255) & (symbols < 280)).any():
                        held.append((w * h, k, b.at, codes))
                        continue
                    out[k] = read_webp(f)[..., 1:].astype(np.uint8).ravel()
                    continue
                if max(c.bits for c in codes[:3]) <= SHORT and codes[3].bits == 0 and codes[0].symbols.max() < 256:
                    plain.append((w * h, k, b.at, codes))
                    continue
                if w == WIDTH and max(c.bits for c in codes) <= SHORT and codes[3].bits == 0 and codes[0].symbols.min() < 256 <= codes[0].symbols.max():
                    referenced.append((w * h, k, b.at, codes))
                    continue
        out[k] = read_webp(f)[..., 1:].astype(np.uint8).ravel()
    held.sort(key=lambda p: -p[0])
    for a in range(0, len(held), 512):
        some = held[a : a + 512]
        for (_, k, _, _), got in zip(some, _read_cached(files, some)):
            out[k] = got
    referenced.sort(key=lambda p: -p[0])
    for a in range(0, len(referenced), 512):
        some = referenced[a : a + 512]
        for (_, k, _, _), got in zip(some, _read_referenced(files, some)):
            out[k] = got
    plain.sort(key=lambda p: -p[0])
    for a in range(0, len(plain), 512):
        some = plain[a : a + 512]
        n = len(some)
        blob = b"".join(files[k][21:] + bytes(8) for _, k, _, _ in some)
        base = np.cumsum([0] + [len(files[k]) - 13 for _, k, _, _ in some])[:-1] * 8
        raw = np.frombuffer(blob + bytes(8), np.uint8)
        words = np.lib.stride_tricks.as_strided(raw[: len(raw) - 7].view(), (len(raw) - 7, 8), (1, 1))
        words = np.ascontiguousarray(words).view("<u8").ravel()
        number: dict[Code, int] = {}  # the three codes of a literal tile are mostly one
        rows = np.array([[number.setdefault(c, len(number)) << SHORT for c in codes[:3]] for _, _, _, codes in some]).T.copy()
        tables = np.concatenate([np.tile((c.symbols | c.sizes << 8).astype(np.uint16), 1 << (SHORT - c.bits)) for c in number])
        at = base + np.array([p[2] for p in some])
        px = np.array([p[0] for p in some])
        ends = base + np.array([(len(files[k]) - 21) * 8 for _, k, _, _ in some])
        got = np.zeros((int(px[0]), 3, n), np.uint8)
        live = np.searchsorted(-px, -np.arange(int(px[0])), side="left")
        mask = np.uint64((1 << SHORT) - 1)
        for step, m in enumerate(live.tolist()):
            p = at[:m]
            w = words[p >> 3] >> (p & 7).astype(np.uint64)
            used = 0
            for j, channel in ((0, 1), (1, 0), (2, 2)):
                t = tables[rows[j, :m] + (w & mask).astype(np.int64)]
                size = t >> 8
                got[step, channel, :m] = t
                w >>= size
                used = used + size
            p += used
        if (at > ends).any():
            raise ValueError("the stream ends too early")
        for i, (count, k, _, _) in enumerate(some):
            out[k] = np.ascontiguousarray(got[:count, :, i]).ravel()
    return out  # type: ignore[return-value]


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // 192)) * 192
    return raw.ljust(size, b" "), len(raw)


def feature_of(px: np.ndarray) -> str:
    """Mean, deviation and edge strength of the samples, and their histogram in 16 steps."""
    x = px.astype(np.int64)
    edge = int(np.abs(np.diff(x)).sum())
    return f"{int(x.sum())}:{int((x * x).sum())}:{edge}:" + ",".join(map(str, np.bincount(x >> 4, minlength=16).tolist()))


def media_rows(texts: list[str | None], group: int = 16_000_000) -> Iterator[tuple]:
    """For each text: the stored bytes, what is read back, and its size. Texts are stored ``group`` bytes at a time."""
    at = 0
    while at < len(texts):
        held, size = [], 0
        while at < len(texts) and (not held or size < group):
            held.append(payload_of(texts[at]))
            size += len(held[-1][0])
            at += 1
        tiles = [p[a : a + TILE] for p, _ in held for a in range(0, len(p), TILE)]
        files, back = [], []
        for a in range(0, len(tiles), 128):  # packing takes some 200 bytes for each byte in hand
            files += write_tiles(tiles[a : a + 128])
        back = read_tiles(files)
        k = 0
        for p, n in held:
            m = -(-len(p) // TILE)
            yield b"".join(files[k : k + m]), np.concatenate(back[k : k + m]), n
            k += m


def media(docs: DataFrame, keep: bool = True) -> DataFrame:
    """Rows with doc_id, sizes, digests, feature, and (``keep``) the stored bytes ``media``: WebP files of 64 by up to 64 pixels, one after another.

    Null text counts as empty and is stored as 192 spaces. Rows are independent; equal texts give equal bytes.
    """
    kind = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    @pandas_udf(kind + (", media binary" if keep else ""))
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for m, px, n in media_rows(s.tolist()):
                raw = px.tobytes()
                rows.append((n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(px), *([m] if keep else [])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")] + ["media"] * keep)

    return docs.select("doc_id", stored("text").alias("m")).select("doc_id", "m.*")


def op7_media(spark, sf_dir: str) -> DataFrame:
    return media(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=False)
