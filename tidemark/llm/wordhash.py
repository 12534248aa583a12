"""Hashes of the words of Arrow text columns, vectorised: no Python object per word.

A word's hash is a sum of its bytes times fixed odd 64-bit factors by place, mixed. It depends on the bytes alone, so it is the
same in every task and run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The bytes of [\x20\x09-\x0D].
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SLICE = 2 << 20
_U = np.uint64


def separators(space: bytes = SPACE_BYTES) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(space)] = True
    return table


#: Everything in ASCII but letters and digits.
PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiplicative hash; a bijection."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x = x * _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def factors(n: int, name: bytes) -> np.ndarray:
    """n fixed odd factors; the same prefix for any n."""
    raw = b"".join(hashlib.sha256(name + b"%d" % i).digest() for i in range((n + 3) // 4))
    return np.frombuffer(raw, "<u8")[:n].astype(_U) | _U(1)


_PLACES = factors(256, b"place")


def places(n: int) -> np.ndarray:
    """Factors by place in a word, the same prefix for any n; beyond 256 they repeat, mixed with the round."""
    if n <= len(_PLACES):
        return _PLACES
    rounds = np.arange(n, dtype=_U) // _U(len(_PLACES))
    out = mix(np.resize(_PLACES, n) + rounds * _U(0x9E3779B97F4A7C15)) | _U(1)
    out[:len(_PLACES)] = _PLACES
    return out


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text, one row at least."""
    offsets = _offsets(column)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(len(column), max(at + 1, end))
        yield at, end
        at = end


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)


class Words:
    """Words of the rows begin..end of a text column: places in the bytes, hashes, and the first word of each row.

    data is the bytes of these rows; starts and ends are byte positions in it; row r has the words bounds[r] .. bounds[r + 1] - 1.
    Nulls have no words.
    """

    def __init__(self, column: pa.Array, begin: int, end: int, table: np.ndarray, lower: bool = False) -> None:
        column = column.slice(begin, end - begin)
        offsets = _offsets(column)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        if column.null_count:  # a null may cover bytes
            lengths = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
            data = np.concatenate([data[:0], *[data[a - offsets[0]:a - offsets[0] + n] for a, n in zip(offsets[:-1], lengths) if n]])
            offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.offsets = offsets - offsets[0]
        self.data = LOWER[data] if lower else data
        inside = ~table[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        opens[edges] = inside[edges]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        closes[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A hash per word, of its first `most` bytes where given."""
        if not len(self.starts):
            return np.empty(0, _U)
        lengths = self.ends - self.starts
        if most:
            lengths = np.minimum(lengths, most)
        edge = np.cumsum(lengths)
        place = np.arange(edge[-1]) - np.repeat(edge - lengths, lengths)
        at = place + np.repeat(self.starts, lengths)
        values = (self.data[at].astype(_U) + _U(1)) * places(int(lengths.max()))[place]
        return mix(np.add.reduceat(values, edge - lengths) + lengths.astype(_U) * _U(0x9E3779B97F4A7C15))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, by doubling."""
    out = np.ones(max(1, n), _U)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have:have + take] = out[:take] * _U(pow(base, have, 1 << 64))
        have += take
    return out


class Rolling:
    """Hashes of all windows of a word-hash sequence, of any width, from one prefix sum; they depend on the window alone."""

    BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2 ** 64

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        self.inverse = powers(pow(self.BASE, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(hashes * powers(self.BASE, n)[:n], out=self.sums[1:])

    def windows(self, first: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[first + width] - self.sums[first]) * self.inverse[first])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every full window, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out
