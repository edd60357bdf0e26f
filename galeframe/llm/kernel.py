"""NumPy text kernel: words, lines and n-gram hashes of whole Arrow string columns.

Everything works on the UTF-8 buffer of one batch, without a Python object per word. A null text has no words.
Hashes are 64 bits; callers that compare across a corpus use two of them with different seeds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)


def _table(separators, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Byte -> is it part of a word, and byte -> byte as hashed."""
    inside = np.ones(256, dtype=bool)
    inside[list(separators)] = False
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
        inside[65:91] = True
    return inside, fold


#: Words are runs without ASCII white space.
SPACE_WORDS = _table([0x20, *range(0x09, 0x0E)])
#: Words are runs of letters, digits and everything beyond ASCII; A-Z count as a-z.
ALNUM_WORDS = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)], lower=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x + _A
    x ^= x >> U64(30)
    x *= _B
    x ^= x >> U64(27)
    x *= _C
    x ^= x >> U64(31)
    return x


class Texts:
    """The bytes of a batch of texts. offsets[i]:offsets[i+1] are those of text i."""

    def __init__(self, column, kind=SPACE_WORDS):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
        column = column.cast(pa.large_string()).fill_null("")
        self.n = len(column)
        _, ends, data = column.buffers()
        at = np.frombuffer(ends, dtype=np.int64, count=column.offset + self.n + 1)[column.offset :] if self.n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.offsets, self.inside, self.raw = at - at[0], kind[0], raw
        self.padded = np.zeros(len(raw) + 8, dtype=np.uint8)
        self.padded[: len(raw)] = kind[1][raw]
        #: The eight bytes that start at each byte.
        self.eight = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=self.padded, strides=(1,))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags (one a byte) in each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the runs of bytes that are inside, cut at the ends of texts."""
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none, none
        first, last = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        filled = self.offsets[1:] > self.offsets[:-1]
        first[self.offsets[:-1][filled]] = True
        last[self.offsets[1:][filled] - 1] = True
        first[1:] |= ~inside[:-1]
        last[:-1] |= ~inside[1:]
        starts, ends = np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(self.inside[self.raw])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The newline-split lines that are not empty."""
        return self.spans(self.raw != 10)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """A hash of the bytes of each span."""
        left = ends - starts
        h = mix(left.astype(U64) + U64(seed))
        at, act = starts.copy(), np.arange(len(starts))
        while len(act):
            v = self.eight[at] & _MASK[np.minimum(left, 8)]
            h[act] = mix(h[act] ^ v) if len(act) < len(h) else mix(h ^ v)
            more = left > 8
            act, at, left = act[more], at[more] + 8, left[more] - 8
        return h


def counts(of: np.ndarray, n: int) -> np.ndarray:
    """Number of spans in each of n texts."""
    return np.bincount(of, minlength=n)


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive values; as many as there are windows, over the ends of texts too."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, level, size = None, 0, mix(h ^ U64(seed)), 1
    while True:
        if k & size:
            part = level[done : done + n]
            out = part.copy() if out is None else mix(out * _B + part)
            done += size
        if done == k:
            return out
        level = mix(level[: len(level) - size] * _C + level[size:])
        size *= 2


def valid_starts(of: np.ndarray, k: int) -> np.ndarray:
    """For each window of k words: does it lie in one text?"""
    return of[: max(0, len(of) - k + 1)] == of[k - 1 :]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def repeated(key: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.zeros(len(s), bool)
    out[order] = same
    return out


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of starts."""
    d = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + k, minlength=n + 1)[: n + 1]
    return np.cumsum(d[:n]) > 0
