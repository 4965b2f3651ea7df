"""MD5 of many short keys at once, in NumPy: one block a key, all keys of a day in step."""

from __future__ import annotations

from hashlib import md5

import numpy as np

_K = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_PLACE = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]


class Keys:
    """Byte strings that are hashed behind many different heads."""

    def __init__(self, names: list[bytes]):
        self.names = names
        self.sizes = np.array([len(k) for k in names], np.int64)
        self.longest = int(self.sizes.max()) if len(names) else 0
        self._laid: dict[int, np.ndarray] = {}

    def laid(self, shift: int) -> np.ndarray:
        """The names behind ``shift`` free bytes, with the closing bit, as rows of words."""
        if shift not in self._laid:
            width = (shift + self.longest + 4) // 4 * 4
            flat = b"".join(bytes(shift) + k + b"\x80" + bytes(width - shift - len(k) - 1) for k in self.names)
            self._laid[shift] = np.ascontiguousarray(np.frombuffer(flat, "<u4").reshape(len(self.names), -1).T)
        return self._laid[shift]

    def digests(self, head: bytes, chunk: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
        """The upper and lower 8 bytes of MD5(head + name), as numbers in the order of its hex digits."""
        n = len(self.names)
        full, shift = divmod(len(head), 4)
        if not n or full * 4 + shift + self.longest > 55:
            both = np.frombuffer(b"".join(md5(head + k).digest() for k in self.names), ">u8").reshape(-1, 2).astype(np.uint64)
            return both[:, 0], both[:, 1]
        laid = self.laid(shift)
        fixed = np.frombuffer(head[: full * 4], "<u4")
        rest = np.uint32(int.from_bytes(head[full * 4 :], "little"))
        hi, lo = np.empty(n, np.uint64), np.empty(n, np.uint64)
        for at in range(0, n, chunk):
            part = slice(at, min(n, at + chunk))
            words: list = [None] * 16
            words[:full] = list(fixed)
            for j in range(len(laid)):
                words[full + j] = laid[j, part] | rest if j == 0 else laid[j, part]
            words[14] = ((self.sizes[part] + len(head)) * 8).astype(np.uint32)
            a, b, c, d = _block(words, part.stop - at)
            hi[part] = a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()
            lo[part] = c.byteswap().astype(np.uint64) << np.uint64(32) | d.byteswap()
        return hi, lo

    def order(self, head: bytes) -> np.ndarray:
        """Places of the names in the order of MD5(head + name)."""
        hi, lo = self.digests(head)
        found = np.argsort(hi)
        s = hi[found]
        return np.lexsort((lo, hi)) if (s[1:] == s[:-1]).any() else found


def _block(words: list, n: int) -> list[np.ndarray]:
    """One block of MD5 for n messages; a word is an array, a number, or None for zero."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f); np.bitwise_and(f, b, out=f); np.bitwise_xor(f, d, out=f)  # noqa: E702
            elif i < 32:
                np.bitwise_xor(b, c, out=f); np.bitwise_and(f, d, out=f); np.bitwise_xor(f, c, out=f)  # noqa: E702
            elif i < 48:
                np.bitwise_xor(b, c, out=f); np.bitwise_xor(f, d, out=f)  # noqa: E702
            else:
                np.invert(d, out=f); np.bitwise_or(f, b, out=f); np.bitwise_xor(f, c, out=f)  # noqa: E702
            w = words[_PLACE[i]]
            f += a
            if isinstance(w, np.ndarray):
                f += w
                f += _K[i]
            else:
                f += _K[i] if w is None else np.uint32(w + _K[i])
            turn = _TURN[i // 16][i % 4]
            np.left_shift(f, np.uint32(turn), out=g)
            np.right_shift(f, np.uint32(32 - turn), out=f)
            np.bitwise_or(f, g, out=f)
            f += b
            a, d, c, b, f = d, c, b, f, a
    return [x + s for x, s in zip((a, b, c, d), _START)]
