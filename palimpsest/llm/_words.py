"""Word and shingle hashes of whole Arrow text columns, vectorised over many texts at once.

A text is UTF-8; A-Z are lower-cased; words are what ASCII white space separates. Every hash is a
function of the bytes alone, so that all workers and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C13)
STEP = np.uint64(0xD6E8FEB86659FD93)
U = np.uint64
#: Bytes of one text that are hashed at once; bounds memory, not the text.
MOST_AT_ONCE = 1 << 23


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1), modulo 2**64."""
    out = np.full(max(n, 1), BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the column and each row's start and end in them; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = at[:-1], at[1:]
    if texts.null_count:
        ends = np.where(texts.is_null().to_numpy(zero_copy_only=False), starts, ends)
    return raw, starts, ends


def spans(starts: np.ndarray, ends: np.ndarray, most: int, rows: int = 1000) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` bytes together (or a single longer row) and ``rows`` rows."""
    lo, n = 0, len(starts)
    while lo < n:
        hi = int(np.searchsorted(ends, starts[lo] + most, side="right"))
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, hi
        lo = hi


#: Sums of two adjacent bytes, then of a last one.
TWO = np.concatenate([(BYTE + (BYTE * BASE)[:, None]).ravel(), BYTE])
#: Bytes of a word from which on it is summed by itself.
LONG = 64


def _sums(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of each word's bytes, as BYTE has them, times the power of the place in the word."""
    size = end - begin
    code = data.astype(np.int32)
    code[:-1] |= code[1:] << 8
    code[end - 1] = data[end - 1].astype(np.int32) + 65536
    # by length, longest first, so that the words which go on are always the first ones
    short = np.minimum(size, LONG + 1).astype(np.uint8)
    order = np.argsort(short, kind="stable")[::-1]
    longer = len(order) - np.cumsum(np.bincount(short, minlength=LONG + 2))
    at = begin[order]
    sums = np.zeros(len(order), np.uint64)
    for k, scale in enumerate(powers(LONG)[::2].tolist()):
        n = int(longer[2 * k])
        if not n:
            break
        sums[:n] += TWO.take(code.take(at[:n] + 2 * k)) * U(scale)
    for n in range(int(longer[LONG])):
        word = data[begin[order[n]] : end[order[n]]]
        sums[n] = (BYTE[word] * powers(len(word))).sum(dtype=np.uint64)
    out = np.empty_like(sums)
    out[order] = sums
    return out


def words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each row's first word, with the total at the end) of adjacent rows."""
    a, b = int(starts[0]), int(ends.max())
    if len(starts) == 1 and b - a > MOST_AT_ONCE:  # one very long text, cut at white space
        cut = np.flatnonzero(SPACE[raw[a + MOST_AT_ONCE // 2 : b]])
        if len(cut):
            middle = a + MOST_AT_ONCE // 2 + int(cut[0])
            h = np.concatenate([words(raw, starts, np.array([middle]))[0], words(raw, np.array([middle]), ends)[0]])
            return h, np.array([0, len(h)], np.int64)
    lower = raw[a:b].tobytes().translate(LOWER.tobytes())
    data, gap = np.frombuffer(lower, np.uint8), np.frombuffer(lower.translate(SPACE.tobytes()), bool)
    first = np.zeros(len(data) + 1, bool)
    first[starts[starts < b] - a] = True
    first[ends[ends <= b] - a] = True
    inside = ~gap
    begin = inside.copy()
    begin[1:] &= gap[:-1] | first[1:-1]
    begin = np.flatnonzero(begin)
    close = inside.copy()
    close[:-1] &= gap[1:] | first[1:-1]
    close = np.flatnonzero(close)
    h = mix(_sums(data, begin, close + 1) + (close - begin + 1).astype(np.uint64) * STEP)
    return h, np.searchsorted(begin, np.append(starts - a, b - a)).astype(np.int64)


def shingles(word: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, index of each row's first shingle): all runs of ``width`` words of a row in
    order; a row of fewer words has its whole sequence as one shingle, a row of none has none."""
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    begin = at[row] + np.arange(out_at[-1]) - out_at[row]
    long = np.minimum(n[row], width)
    padded = np.concatenate([word, np.zeros(width, np.uint64)])
    # sums from every word on; rows of fewer words have theirs summed up to their end
    whole = np.zeros(len(word), np.uint64)
    scale = U(1)
    few = np.flatnonzero(long < width)
    part = np.zeros(len(few), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            whole += padded[k : k + len(word)] * scale
            part += np.where(long[few] > k, padded[begin[few] + k], U(0)) * scale
            scale = scale * BASE
        h = whole[begin]
        h[few] = part
        h += long.astype(np.uint64) * STEP
    return mix(h), out_at


def shingle_sets(texts: pa.Array, width: int = 5, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: (first row, end, distinct 54-bit shingle hashes by row and ascending, the
    index of each row's first). 54 bits leave room for the row while sorting."""
    raw, starts, ends = utf8(texts)
    for lo, hi in spans(starts, ends, most):
        word, at = words(raw, starts[lo:hi], ends[lo:hi])
        h, at = shingles(word, at, width)
        row = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(at))
        key = np.unique((row << U(54)) | (h >> U(10)))
        edges = np.arange(hi - lo + 1, dtype=np.uint64) << U(54)
        yield lo, hi, key & U((1 << 54) - 1), np.searchsorted(key, edges)
