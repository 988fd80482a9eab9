"""Elias-Fano sequences over numpy arrays that may be memory mapped, with vectorised access and search."""

from __future__ import annotations

import json

import numpy as np

_U = np.uint64


def dump(arrays: dict[str, np.ndarray]) -> list[bytes]:
    """One file: a JSON header and the arrays, each at a multiple of 64 bytes."""
    head: dict[str, list] = {}
    at = 0
    for k, a in arrays.items():
        head[k] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    out = [len(text).to_bytes(8, "little"), text]
    for a in arrays.values():
        out += [a.tobytes(), b"\0" * (-a.nbytes % 64)]
    return out


def load(path: str) -> dict[str, np.ndarray]:
    data = np.memmap(path, dtype=np.uint8, mode="r")
    n = int(data[:8].view("<u8")[0])
    head = json.loads(bytes(data[8 : 8 + n]))
    return {k: data[8 + n + at : 8 + n + at + np.dtype(kind).itemsize * size].view(kind) for k, (kind, at, size) in head.items()}


def pack_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """Values at ``bits`` bits each, lowest first, as bytes with eight spare ones."""
    out = []
    for i in range(0, len(values), 1 << 16):  # a multiple of 8 values: every chunk starts at a byte
        flags = (values[i : i + (1 << 16), None] >> np.arange(bits, dtype=_U)) & _U(1)
        out.append(np.packbits(flags.astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate([*out, np.zeros(8, np.uint8)])


def build(values: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of uint64: low bits, unary high bits, and counts of ones and zeros before each word."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, int(np.log2(max(1, (top + 1) // max(n, 1)))))
    high = (values >> _U(low)).astype(np.int64)
    size = n + (top >> low) + 2
    flags = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
    flags[high + np.arange(n)] = 1
    words = np.packbits(flags, bitorder="little").view("<u8")
    ones = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]
    zeros = np.arange(len(words) + 1) * 64 - ones
    return {
        f"{prefix}.meta": np.array([n, low], dtype="<i8"),
        f"{prefix}.low": pack_bits(values & _U((1 << low) - 1), low) if low else np.zeros(8, np.uint8),
        f"{prefix}.high": words,
        f"{prefix}.ones": ones.astype("<u4"),
        f"{prefix}.zeros": zeros.astype("<u4"),
    }


def _select(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of the nth (from 0) one bit of each word, by halving."""
    at = np.zeros(len(words), dtype=np.int64)
    nth = nth.astype(np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        part = np.bitwise_count((words >> at.astype(_U)) & _U((1 << half) - 1)).astype(np.int64)
        over = nth >= part
        nth = np.where(over, nth - part, nth)
        at += half * over
    return at


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], prefix: str):
        self.n, self.bits = (int(x) for x in arrays[f"{prefix}.meta"])
        self.low, self.high, self.ones, self.zeros = (arrays[f"{prefix}.{k}"] for k in ("low", "high", "ones", "zeros"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=_U)
        at = i * self.bits
        first, value = at >> 3, np.zeros(len(i), dtype=_U)
        for k in range((self.bits + 14) // 8):
            value |= self.low[first + k].astype(_U) << _U(8 * k)
        return (value >> (at & 7).astype(_U)) & _U((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        w = np.searchsorted(self.ones, i, side="right") - 1
        place = w * 64 + _select(self.high[w], i - self.ones[w])
        return ((place - i).astype(_U) << _U(self.bits)) | self._low(i)

    def _below(self, h: np.ndarray) -> np.ndarray:
        """Values whose high part is under h."""
        out = np.zeros(len(h), dtype=np.int64)
        at = np.flatnonzero(h > 0)
        z = h[at] - 1  # the zero that ends the bucket before
        w = np.searchsorted(self.zeros, z, side="right") - 1
        out[at] = w * 64 + _select(~self.high[w], z - self.zeros[w]) - z
        return out

    def _run(self, lo: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Values whose high part is h, of which the first is the lo-th: ones in a row in the high bits."""
        place = lo + h
        w, off = place >> 6, (place & 63).astype(_U)
        after = self.high[np.minimum(w + 1, len(self.high) - 1)]
        bits = (self.high[w] >> off) | np.where(off > 0, after << ((_U(64) - off) & _U(63)), _U(0))
        out = np.bitwise_count(bits & ~(bits + _U(1))).astype(np.int64)
        many = np.flatnonzero((out >= 64) | (w + 1 >= len(self.high)))  # beyond the word at hand: by the next zero
        out[many] = self._below(h[many] + 1) - lo[many]
        return out

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value of at least x within x's bucket of high parts, and whether it equals x."""
        h = (x >> _U(self.bits)).astype(np.int64)
        last = int(self.zeros[-1]) - 1
        h = np.minimum(h, last)
        lo = self._below(h)
        hi = lo + self._run(lo, h)
        want = x & _U((1 << self.bits) - 1)
        end = hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        found = lo < end
        at = np.flatnonzero(found)
        found[at] = self._low(lo[at]) == want[at]
        return lo, found
