"""Words and shingles of whole texts as 64-bit hashes, computed on the bytes of an Arrow batch with numpy.

No Python object is made per word. Texts are taken in chunks of about CHUNK bytes; a longer text is cut between words, so
memory follows the chunk (or the longest word), and the number of words of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_P_INV = _U(pow(int(_P), -1, 1 << 64))
_RANDOM = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_powers = [np.ones(1, _U), np.ones(1, _U)]

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(9, 14)]] = True
#: ASCII letters and digits and every byte of a longer character make words; all else separates.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_FOLD = np.arange(256)
_FOLD[0x41:0x5B] += 32
_VALUES = _RANDOM[_FOLD]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, p in enumerate((_P, _P_INV)):
            a = np.full(max(n, CHUNK + 1), p, _U)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def _hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """Hashes of data[begin:end]; `values` are the numbers of the 256 bytes, by default those that fold A-Z."""
    up, down = _power(len(data) + 1)
    c = np.zeros(len(data) + 1, _U)
    v = values.take(data)
    v *= up[: len(data)]
    np.cumsum(v, out=c[1:])
    return mix((c[end] - c[begin]) * down[begin] + (end - begin).astype(_U))


def content_cuts(data: np.ndarray, offsets: np.ndarray, bits: int, window: int = 16) -> np.ndarray:
    """Where texts, one after the other in `data`, are cut by content: their ends, and each place whose last `window` bytes
    have a hash with `bits` zero bits, so one place in 2^bits. Equal stretches are cut alike wherever they stand. A
    character is never cut."""
    if not len(data):
        return np.zeros(1, np.int64)
    h, size = _RANDOM.take(data), 1
    while size < window:  # the hash of twice as many bytes from those of two neighbours
        h = h[:-size] * _U(pow(int(_P), size, 1 << 64)) + h[size:] if len(h) > size else h[:0]
        size *= 2
    at = np.flatnonzero(mix(h) >> _U(64 - bits) == 0) + window
    at = at[at < len(data)]
    at = at[(data[at] & 0xC0) != 0x80]
    begins = offsets[np.searchsorted(offsets, at, "right") - 1]
    return np.unique(np.concatenate([offsets, at[at - begins >= window]]))


def plain_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[begin:end] as they stand."""
    return _hash(data, begin, end, _RANDOM)


def _words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a chunk, and where each text's words begin."""
    inside = (~separator).take(data)
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < len(data)]] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:] & before[1:]
    end = np.flatnonzero(inside & ~after) + 1
    return _hash(data, begin, end), np.searchsorted(begin, offsets)


def _long(data: np.ndarray, separator: np.ndarray) -> np.ndarray:
    out, at = [], 0
    while at < len(data):
        to = min(at + CHUNK, len(data))
        if to < len(data):
            gaps = np.flatnonzero(separator[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                while to < len(data) and not separator[data[to]]:
                    to += 1
        piece = data[at:to]
        out.append(_words(piece, np.array([0, len(piece)]), separator)[0])
        at = to
    return np.concatenate(out)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of a text column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(column: pa.Array, separator: np.ndarray = BLANK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, offsets of words by row). A-Z count as a-z."""
    for lo, hi, data, offsets in chunks(column):
        if len(data) > CHUNK:
            h = _long(data, separator)
            yield lo, hi, h, np.array([0, len(h)])
        else:
            yield lo, hi, *_words(data, offsets, separator)


def word_counts(column: pa.Array, separator: np.ndarray = BLANK) -> np.ndarray:
    """The number of words of each row."""
    out = []
    for _, _, data, offsets in chunks(column):
        inside = (~separator).take(data)
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        firsts = offsets[:-1][offsets[:-1] < len(data)]
        begin[firsts] = inside[firsts]
        out.append(np.diff(np.searchsorted(np.flatnonzero(begin), offsets)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def shingles(h: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text its k-word shingles in order; with fewer words the whole sequence as one; without words none."""
    n = len(h)
    full = np.zeros(max(0, n - k + 1), _U)
    for i in range(k):
        full = mix(full + h[i : i + len(full)] + _U(i + 1))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= k:
            yield full[a : b - k + 1]
        elif b > a:
            s = np.array([b - a], _U) * _P
            for x in h[a:b]:
                s = mix(s + x)
            yield s
        else:
            yield full[:0]


def distinct(s: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order."""
    s = np.sort(s)
    if len(s) < 2:
        return s
    new = np.empty(len(s), bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def sets(column: pa.Array, k: int, separator: np.ndarray = BLANK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By chunks: (first row, the rows' sets of distinct shingles one after the other, each ascending, and their offsets)."""
    for lo, _, h, offsets in words(column, separator):
        own = [distinct(s) for s in shingles(h, offsets, k)]
        yield lo, np.concatenate(own), np.concatenate([[0], np.cumsum([len(s) for s in own])])
