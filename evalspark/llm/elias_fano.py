"""Elias-Fano sequences in numpy: sorted numbers in about two bits each besides their low bits.

All operations take arrays, so that a batch of searches is a few passes over arrays. A sequence is
a dictionary of arrays; ``pack`` puts several into one byte string, ``unpack`` reads them from
there, or from a memory-mapped file, without copying.
"""

from __future__ import annotations

import json

import numpy as np

U64 = np.uint64
_POP = np.array([bin(b).count("1") for b in range(256)], np.int64)
#: the place of the r-th set bit of a byte
_PLACE = np.array([[*[i for i in range(8) if b >> i & 1], *[0] * 8][:8] for b in range(256)], np.int64)


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.arrays = arrays
        self.n, self.low_bits = (int(x) for x in arrays["shape"])
        self.low, self.high, self.zeros = arrays["low"], arrays["high"], arrays["zeros"]

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        """``values`` sorted, each below ``universe`` (at most 2 ** 64)."""
        n = len(values)
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        values = values.astype(U64)
        highs = (values >> U64(low_bits)).astype(np.int64)
        n_bits = n + ((universe - 1) >> low_bits) + 2 if universe else 2
        bits = np.zeros((n_bits + 63) // 64 * 64, np.uint8)
        bits[highs + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        zeros = np.zeros(len(high) + 1, np.int64)
        np.cumsum(64 - bits.reshape(-1, 64).sum(axis=1, dtype=np.int64), out=zeros[1:])
        low = np.zeros(n * low_bits // 64 + 2, U64)
        if n and low_bits:
            lows = values & U64((1 << low_bits) - 1)
            places = np.arange(n, dtype=np.int64) * low_bits
            words, shifts = places >> 6, (places & 63).astype(U64)
            firsts = np.flatnonzero(np.diff(words, prepend=-1))
            low[words[firsts]] |= np.bitwise_or.reduceat(lows << shifts, firsts)
            spill = shifts.astype(np.int64) + low_bits > 64
            low[words[spill] + 1] |= lows[spill] >> (U64(64) - shifts[spill])
        shape = np.array([n, low_bits], np.int64)
        return cls({"shape": shape, "low": low, "high": high, "zeros": zeros})

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), U64)
        places = at * self.low_bits
        words, shifts = places >> 6, (places & 63).astype(U64)
        value = self.low[words] >> shifts
        rest = self.low[words + 1] << (U64(64) - np.maximum(shifts, U64(1)))
        value = np.where(shifts > 0, value | rest, value)
        return value & U64((1 << self.low_bits) - 1)

    def _in_word(self, words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The place of the rank-th set bit of each word."""
        octets = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
        before = np.cumsum(_POP[octets], axis=1)
        octet = (before <= rank[:, None]).sum(axis=1)
        lines = np.arange(len(words))
        rank = rank - np.where(octet > 0, before[lines, octet - 1], 0)
        return 8 * octet + _PLACE[octets[lines, octet], rank]

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th zero of the high bits."""
        words = np.searchsorted(self.zeros, k, "right") - 1
        return 64 * words + self._in_word(~self.high[words], k - self.zeros[words])

    def successor(self, wanted: np.ndarray) -> np.ndarray:
        """The place of the first value that is not below each wanted one; n if there is none."""
        wanted = wanted.astype(U64)
        high = (wanted >> U64(self.low_bits)).astype(np.int64)
        low = wanted & U64((1 << self.low_bits) - 1)
        start = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) + 1 - high, 0)
        stop = self._zero(high) - high
        while len(open_ := np.flatnonzero(start < stop)):
            middle = (start[open_] + stop[open_]) >> 1
            below = self._low(middle) < low[open_]
            start[open_] = np.where(below, middle + 1, start[open_])
            stop[open_] = np.where(below, stop[open_], middle)
        return start

    def values(self, at: np.ndarray) -> np.ndarray:
        """The values at places below n."""
        ones = self._ones()
        words = np.searchsorted(ones, at, "right") - 1
        place = 64 * words + self._in_word(self.high[words], at - ones[words])
        return ((place - at).astype(U64) << U64(self.low_bits)) | self._low(at)

    def _ones(self) -> np.ndarray:
        return 64 * np.arange(len(self.zeros), dtype=np.int64) - self.zeros


def pack(sequences: dict[str, EliasFano], others: dict[str, np.ndarray]) -> bytes:
    arrays = {f"{name}.{part}": a for name, s in sequences.items() for part, a in s.arrays.items()} | others
    head, at, parts = {}, 0, []
    for name, array in arrays.items():
        data = np.ascontiguousarray(array).tobytes()
        head[name] = [array.dtype.str, at, len(array)]
        padding = -len(data) % 8
        parts += [data, bytes(padding)]
        at += len(data) + padding
    head = json.dumps(head).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(parts)


def unpack(data) -> tuple[dict[str, EliasFano], dict[str, np.ndarray]]:
    """The opposite of ``pack``, as views of ``data`` (bytes or a memory map)."""
    size = int.from_bytes(data[:8], "little")
    arrays = {
        name: np.frombuffer(data, kind, count, 8 + size + at)
        for name, (kind, at, count) in json.loads(bytes(data[8 : 8 + size])).items()
    }
    names = dict.fromkeys(name.partition(".")[0] for name in arrays if "." in name)
    parts = ("shape", "low", "high", "zeros")
    sequences = {name: EliasFano({part: arrays[f"{name}.{part}"] for part in parts}) for name in names}
    return sequences, {name: array for name, array in arrays.items() if "." not in name}
