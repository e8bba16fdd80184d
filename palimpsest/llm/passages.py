"""Passages that documents share, by compact windows.

Tokens are five-word shingles. Under one hash function the Cartesian tree of a text's token hashes
has a node for each token; the subsequences whose minimum is that token are those of the node's range
that hold it, so one row (a compact window) stands for all of them. Only nodes whose range has at
least ``span`` tokens matter; they are the minima of the text's spans of ``span`` tokens, about
2/(span+1) of its tokens, and are found by a vectorised sliding minimum without building the rest of
the tree. The row keeps the place of the minimum and which spans it is the minimum of.

Windows with equal minima meet in a bucket of two documents or more. Each meets the bucket's first
window only, so a passage in a third of all documents makes as many rows as it has occurrences. An
interval join within each document keeps the windows some span of which is shared under ``enough`` of
the hash functions. What is left is verified on the tokens themselves.

A first window may hold the minima by chance and not the passage. So the spans that have a shared
minimum under every hash function, as every exact copy has, and lie in no equal passage yet meet once
more, by a hash of the whole span, with the spans of the same minimum in documents that represent equal
passages: any other span that equals one of those left over is matched, so that its representative has
the same span. Whatever meets there is equal, so that one leader finds all of it.

Nor need a first window hold what is near to the others. Spans that share minima under AGREE functions
or more and lie in no passage meet again by combinations of their minima, with leaders that are drawn
anew for each combination: the more two texts are alike, the more combinations only they share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ._store import dropped, released, written
from ._words import BASE, U, mix, powers, shingles, spans, utf8, words
from .collocations import bit_table, told

WIDTH = 5
#: 47 shingles are 51 words: passages of over 50 words.
SPAN = 47
HASHES, ENOUGH = 6, 2
#: Hash functions whose windows are on disk at once.
AT_ONCE = 2
SIMILARITY = 0.8
#: Unmatched tokens that a passage may hold in a row: two separate edits' worth.
GAP = 2 * WIDTH + 2
#: Tokens between the starts of stretches that are tried where repeated tokens mislead the counts.
STRIDE = 4
#: Hash functions that must agree, at least, on a span whose first partners weren't near: such spans meet
#: by combinations of minima, which two texts at the threshold share with probability 0.98.
AGREE = 3
#: Windows, and runs of spans whose combinations are made, at once; bounds memory.
CELLS = 20_000
#: Tokens that are compared along shifts at once; bounds memory.
AT_A_TIME = 1 << 18
#: Words of a document whose regions are cut out together.
BLOCK = 4096
EQUAL, SEEKS, LEADS = 0, 1, 2


INVERSE = U(pow(int(BASE), -1, 1 << 64))


def powers_of(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def sliding_min(v: np.ndarray, span: int) -> np.ndarray:
    """Minimum of v[i : i + span] for every i with a full span."""
    m, size = v, 1
    while 2 * size <= span:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(v) - span + 1], m[span - size : span - size + len(v) - span + 1])


def compact_windows(v: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the minimum, first start, last start) of each window: the runs of spans, within one
    row of ``at``, that have their last minimum at that place."""
    none = np.zeros(0, np.int64)
    if len(v) < span:
        return none, none, none
    low = sliding_min(v, span)
    valid = np.zeros(len(low), bool)
    step = np.zeros(len(v) + 1, np.int64)
    long = np.diff(at) >= span
    np.add.at(step, at[:-1][long], 1)
    np.add.at(step, at[1:][long] - span + 1, -1)
    valid = np.cumsum(step)[: len(low)] > 0
    starts = np.zeros(len(low), bool)
    starts[at[:-1][long]] = True
    change = valid.copy()
    # another minimum, or the same value once more at the span's end, begins a window
    change[1:] &= starts[1:] | ~valid[:-1] | (low[1:] != low[:-1]) | (v[span:] == low[1:])
    first = np.flatnonzero(change)
    last = np.flatnonzero(valid & np.append(change[1:] | ~valid[1:], True))
    place = np.empty(len(first), np.int64)
    for lo in range(0, len(first), 1 << 14):
        part = first[lo : lo + (1 << 14)]
        place[lo : lo + len(part)] = part + span - 1 - v[part[:, None] + np.arange(span - 1, -1, -1)].argmin(axis=1)
    return place, first, last


def row_shingles(texts: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, starts, ends = utf8(texts)
    for lo, hi in spans(starts, ends, most):
        h, at = shingles(*words(raw, starts[lo:hi], ends[lo:hi]), WIDTH)
        yield lo, hi, h, at


def windows(batches: Iterator[pa.RecordBatch], span: int, functions: range) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (key, id, pos): key is a minimum with the number of its hash function in the
    last bits; pos packs the place and how far the first span reaches left and the last one right."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, h, at in row_shingles(batch.column(1)):
            for k in functions:
                v = (mix(h ^ U((k + 1) * int(BASE) % (1 << 64))) & ~U(7)) | U(k)
                place, first, last = compact_windows(v, at, span)
                if not len(place):
                    continue
                row = np.searchsorted(at, place, side="right") - 1
                own = at[row]
                pos = ((place - own) << 16) | ((place - first) << 8) | (last + span - 1 - place)
                yield pa.RecordBatch.from_arrays([pa.array(v[place].view(np.int64)), pa.array(ids[lo + row].astype(np.int64)), pa.array(pos)], names=["key", "id", "pos"])


class Shared:
    """Shared windows of a few documents, one behind the other. Starts of spans lie side by side: start n of
    document d is place n + shift[d], and document d's places end before edge[d + 1]."""

    def __init__(self, at: np.ndarray, rows: list[pa.Array], span: int):
        self.key, self.pos, self.a, self.apos = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in rows)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.fn, self.center = self.key & 7, self.pos >> 16
        self.first, self.last = self.center - ((self.pos >> 8) & 255), self.center + (self.pos & 255) - span + 1
        base = np.minimum.reduceat(self.first, at[:-1])
        self.edge = np.concatenate([[0], np.cumsum(np.maximum.reduceat(self.last, at[:-1]) - base + 2)])
        self.shift = self.edge[:-1] - base
        self.begin, self.end = self.first + self.shift[self.doc], self.last + self.shift[self.doc] + 1
        self.count = np.zeros(self.edge[-1], np.int64)
        for k in np.unique(self.fn):
            of = self.fn == k
            self.count += self.inside(self.begin[of], self.end[of])

    def inside(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each place lies in one of the ranges."""
        n = int(self.edge[-1])
        return np.cumsum(np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0

    def having(self, places: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each range has one of the places that are set."""
        upto = np.concatenate([[0], np.cumsum(places)])
        return upto[end] > upto[begin]


def _fields(lists: pa.Array, *names: str) -> list[pa.Array]:
    """Fields of all structs that the lists hold, one list behind the other."""
    flat = lists.flatten()
    columns = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
    return [columns[name] for name in names]


def shared_windows(batch: pa.RecordBatch, span: int) -> Iterator[tuple[slice, Shared]]:
    """(b, shared windows of document b, ..) -> runs of rows with about CELLS windows or AT_A_TIME tokens
    together; bounds memory."""
    at = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    if at[-1] == 0:
        return
    rows = _fields(batch.column(1), "key", "pos", "a", "apos")
    place = rows[1].to_numpy(zero_copy_only=False) >> 16
    long = np.cumsum(np.maximum.reduceat(place, at[:-1]) + 2 * span)
    lo = 0
    while lo < batch.num_rows:
        hi = min(np.searchsorted(at, at[lo] + CELLS, side="right") - 1, np.searchsorted(long, (long[lo - 1] if lo else 0) + AT_A_TIME, side="right"))
        hi = max(int(hi), lo + 1)
        yield slice(lo, hi), Shared(at[lo : hi + 1] - at[lo], [r.slice(at[lo], at[hi] - at[lo]) for r in rows], span)
        lo = hi


def supported(batches: Iterator[pa.RecordBatch], span: int, enough: int) -> Iterator[pa.RecordBatch]:
    """(b, shared windows of document b) -> regions of b and of the documents a it may share them with.

    A start of a span counts under a hash function if a shared window of that function has it."""
    names = ["a", "a_lo", "a_hi", "b", "b_lo", "b_hi", "shifts"]
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for part, w in shared_windows(batch, span):
            b, a, c, ac = ids[part][w.doc], w.a, w.center, w.apos >> 16
            keep = w.having(w.count >= enough, w.begin, w.end)
            keep &= (a != b) | (c - ac >= span + WIDTH - 1)  # in one document, occurrences apart
            order = np.flatnonzero(keep)
            order = order[np.lexsort((ac[order], c[order], a[order], w.doc[order]))]
            if not len(order):
                continue
            a, b, c, ac, doc = a[order], b[order], c[order], ac[order], w.doc[order]
            # anchors of one document that follow each other in both make one region
            cut = (doc[1:] != doc[:-1]) | (a[1:] != a[:-1]) | (c[1:] - c[:-1] > 2 * span) | (np.abs(ac[1:] - ac[:-1]) > 2 * span)
            region = np.concatenate([[0], np.cumsum(cut)])
            s = np.flatnonzero(np.append(True, cut))
            shift = c - ac
            by = np.lexsort((shift, region))
            by = by[np.append(True, (region[by][1:] != region[by][:-1]) | (shift[by][1:] != shift[by][:-1]))]
            shifts = pa.ListArray.from_arrays(np.searchsorted(region[by], np.arange(len(s) + 1)).astype(np.int32), shift[by])
            low = lambda x: np.maximum(0, np.minimum.reduceat(x, s) - span)  # noqa: B023, E731
            high = lambda x: np.maximum.reduceat(x, s) + span  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (a[s], low(ac), high(ac), b[s], low(c), high(c))), shifts], names=names)


def left_over(batches: Iterator[pa.RecordBatch], span: int, hashes: int) -> Iterator[pa.RecordBatch]:
    """(id, its shared windows, its passages) -> (kind, key, id, lo, hi, minima) of starts lo to hi exclusive.

    EQUAL: windows under the first hash function with a span that has a shared minimum under every hash
    function and lies in no equal passage. Others: runs of spans with the same minima under AGREE hash
    functions or more. SEEKS, keyed by combinations of minima, if such a span lies in no passage (but for
    a fifth); else LEADS, with the minima. Spans that equal a representative's are left to it."""
    slack = span // 5
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for part, w in shared_windows(batch, span):
            found = batch.column(2)[part]
            doc = np.repeat(np.arange(len(found)), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            s, e, equal, rep = (x.to_numpy(zero_copy_only=False) for x in _fields(found, "s", "e", "equal", "rep"))

            def outside(some: np.ndarray, reach: int) -> np.ndarray:
                begin, end = (np.clip(x + w.shift[doc], w.edge[doc], w.edge[doc + 1])[some] for x in (s - reach, e - span - WIDTH + 2 + reach))  # noqa: B023
                return ~w.inside(begin[end > begin], end[end > begin])  # noqa: B023

            free = (w.count >= hashes) & outside(equal, 0)
            own = (w.count >= AGREE) & outside(equal & ~rep, 0)
            seeks = (w.count >= AGREE) & outside(np.ones(len(s), bool), slack)
            rest = np.flatnonzero((w.fn == 0) & w.having(free, w.begin, w.end))
            yield from _rows([(np.stack([np.full(len(rest), EQUAL), w.key[rest], ids[part][w.doc[rest]], w.first[rest], w.last[rest] + 1]), None)])
            edge = np.unique(np.concatenate([w.begin, w.end]))
            lo, hi = edge[:-1], edge[1:]
            some = w.having(own, lo, hi)
            lo, hi = lo[some], hi[some]
            if not len(lo):
                continue
            minima = np.zeros((len(lo), hashes), np.int64)
            for k in range(hashes):
                of = np.flatnonzero(w.fn == k)
                if len(of):
                    of = of[np.argsort(w.begin[of], kind="stable")]
                    at = of[np.maximum(np.searchsorted(w.begin[of], lo, side="right") - 1, 0)]
                    minima[:, k] = np.where((w.begin[at] <= lo) & (w.end[at] > lo), w.key[at], 0)
            doc = np.searchsorted(w.edge, lo, side="right") - 1
            yield from _cells(ids[part][doc], lo - w.shift[doc], hi - w.shift[doc], w.having(seeks, lo, hi), minima)


def _cells(i: np.ndarray, lo: np.ndarray, hi: np.ndarray, seeks: np.ndarray, minima: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from _rows((np.stack([np.full(len(c[0]), SEEKS), *c]), None) for c in _keyed(i[seeks], lo[seeks], hi[seeks], minima[seeks]))
    i, lo, hi, minima = (x[~seeks] for x in (i, lo, hi, minima))
    yield from _rows([(np.stack([np.full(len(i), LEADS), np.zeros(len(i), np.int64), i, lo, hi]), minima)])


def _rows(parts: Iterable[tuple[np.ndarray, np.ndarray | None]]) -> Iterator[pa.RecordBatch]:
    for part, minima in parts:
        if part.shape[1]:
            kind = pa.list_(pa.int64())
            own = pa.nulls(part.shape[1], kind) if minima is None else pa.ListArray.from_arrays(np.arange(0, minima.size + 1, minima.shape[1], dtype=np.int32), minima.ravel())
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in part), own], names=["kind", "key", "id", "lo", "hi", "minima"])


def sought(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, lo, hi, minima) -> (kind, key, id, lo, hi): combinations of minima whose bits are set."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i, lo, hi = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        minima = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for s in range(0, len(i), CELLS):
            e = s + CELLS
            for key, *where in _keyed(i[s:e], lo[s:e], hi[s:e], minima[s:e]):
                good = told(key.view(np.uint64), bits)
                if good.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(good.sum()), LEADS)), pa.array(key[good]), *(pa.array(c[good]) for c in where)], names=["kind", "key", "id", "lo", "hi"])


def _keyed(i: np.ndarray, lo: np.ndarray, hi: np.ndarray, minima: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, id, lo, hi) of each run of cells of one document that agree in AGREE or AGREE + 1 minima; 0 is none."""
    held, each = minima != 0, mix(minima.view(np.uint64))
    for size in (AGREE, AGREE + 1):
        for some in combinations(range(minima.shape[1]), size):
            rows = np.flatnonzero(held[:, some].all(axis=1))
            if not len(rows):
                continue
            key = mix(each[np.ix_(rows, some)].sum(axis=1, dtype=np.uint64)).view(np.int64)
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[rows[1:]] != i[rows[:-1]]) | (lo[rows[1:]] != hi[rows[:-1]])))
            end = np.append(new[1:], len(rows)) - 1
            yield key[new], i[rows[new]], lo[rows[new]], hi[rows[end]]


def whole_spans(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """(id, text, runs of starts, ends exclusive) -> (hash of the whole span, id, start)."""
    for batch in batches:
        for first, end, h, at in row_shingles(batch.column(1)):
            # sums of token times power from a text's begin: a span's is a difference, shifted back
            scale = powers(len(h) + 1)
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * scale[:-1])])
            back = powers_of(INVERSE, len(h) + 1)
            keys, ids, places = [], [], []
            for i in range(first, end):
                own, n = int(at[i - first]), int(at[i - first + 1] - at[i - first])
                for run in batch.column(2)[i].as_py():
                    lo, hi = run["lo"], min(run["hi"], n - span + 1)
                    if hi > lo:
                        start = np.arange(own + lo, own + hi)
                        keys.append((upto[start + span] - upto[start]) * back[start])
                        ids.append(np.full(hi - lo, batch.column(0)[i].as_py(), np.int64))
                        places.append(np.arange(lo, hi))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(mix(np.concatenate(keys)).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(places))], names=["key", "id", "at"])


def excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, regions) -> (id, lo, hi, tokens, prints) for each region; a region may reach over the end.
    prints are the first 16 bits of each token."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for begin, end, h, at in row_shingles(batch.column(1)):
            regions = batch.column(2)[begin:end]
            row = np.repeat(np.arange(end - begin), regions.value_lengths().to_numpy(zero_copy_only=False))
            lo, hi = (x.to_numpy(zero_copy_only=False) for x in _fields(regions, "lo", "hi"))
            first = np.minimum(at[row] + lo, at[row + 1])
            size = np.maximum(0, np.minimum(at[row] + hi + 1, at[row + 1]) - first)
            upto = np.concatenate([[0], np.cumsum(size)])
            # about a million tokens at once: regions of one document may overlap in great numbers
            s = 0
            while s < len(row):
                e = max(s + 1, int(np.searchsorted(upto, upto[s] + 4 * AT_A_TIME, side="right")) - 1)
                tokens = h[np.repeat(first[s:e] - upto[s:e], size[s:e]) + np.arange(upto[s], upto[e])]
                sizes = upto[s : e + 1] - upto[s]
                yield pa.RecordBatch.from_arrays([pa.array(ids[begin:end][row[s:e]]), pa.array(lo[s:e]), pa.array(hi[s:e]), _blobs(tokens, sizes), _blobs((tokens >> U(48)).astype(np.uint16), sizes)], names=["id", "lo", "hi", "tokens", "prints"])
                s = e


def _blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """One binary value for each stretch of ``values``."""
    offsets = (at * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of regions, with their prints x and y last, of which y has ``least`` prints or more that x has.
    Equal tokens have equal prints, so that no pair goes which has as many equal tokens."""
    seen = np.zeros(1 << 16, bool)
    for batch in batches:
        keep = []
        for left, right in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
            x, y = np.frombuffer(left.as_buffer(), np.uint16), np.frombuffer(right.as_buffer(), np.uint16)
            seen[x] = True
            keep.append(int(seen[y].sum()) >= least)
            seen[x] = False
        rows = batch.select(range(batch.num_columns - 2))
        yield rows.filter(pa.array(keep, pa.bool_()))


def named(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows whose first column, a hash, has its bit set; without the hash."""
    for batch in batches:
        good = told(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)
        yield batch.select(range(1, batch.num_columns)).filter(pa.array(good))


def covering(first: list[int], last: list[int], names: list[int]) -> list[int]:
    """Names of those of the stretches, in order of both ends, that cover what all cover."""
    out, k = [], 0
    while k < len(first):
        out.append(int(names[k]))
        then = k + 1
        while then + 1 < len(first) and first[then + 1] <= last[k] + 1:
            then += 1
        k = then
    return out


def equal_runs(x: np.ndarray, y: np.ndarray, x_at: np.ndarray, y_at: np.ndarray, pair: np.ndarray, shift: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``pair`` and ``shift``, first, end exclusive) of the stretches of at least ``span`` tokens of
    the pair's x that equal those of its y along the shift, in order. Pair n has the tokens from x_at[n] and
    y_at[n] on to the next pair's; y[i + shift] stands against x[i]."""
    lo = np.maximum(0, -shift)
    n = np.minimum(np.diff(x_at)[pair], np.diff(y_at)[pair] - shift) - lo
    rows = np.flatnonzero(n >= span)
    found = [np.zeros((3, 0), np.int64)]
    upto = np.concatenate([[0], np.cumsum(n[rows] + 1)])
    at = 0
    while at < len(rows):
        then = max(at + 1, int(np.searchsorted(upto, upto[at] + AT_A_TIME, side="right")) - 1)
        own, begin = rows[at:then], upto[at:then] - upto[at]
        size = n[own] + 1  # one more, which ends the row
        place = np.arange(upto[then] - upto[at])
        left = np.repeat(x_at[pair[own]] + lo[own] - begin, size) + place
        right = left + np.repeat(y_at[pair[own]] + shift[own] - x_at[pair[own]], size)
        end = begin + n[own]
        left[end], right[end] = 0, 0
        same = np.concatenate([[False], x[left] == y[right]])
        same[end + 1] = False
        edge = np.flatnonzero(same[1:] != same[:-1])
        first, last = edge[::2], edge[1::2]
        long = last - first >= span
        first, last = first[long], last[long]
        k = np.searchsorted(begin, first, side="right") - 1
        back = lo[own[k]] - begin[k]
        found.append(np.stack([own[k], first + back, last + back]))
        at = then
    return tuple(np.concatenate(found, axis=1))


def shared_runs(x: np.ndarray, y: np.ndarray, shifts: list[int], span: int, similarity: float | None, ahead: int | None = None) -> list[tuple[int, int, int, int, float]]:
    """Passages (x first, x last, y first, y last, Jaccard) of at least ``span`` tokens: stretches that
    are equal along an anchor's shift, then the maximal stretches that are as similar as asked and in
    no such passage (of those that overlap, as many as cover all). In regions of one
    document, ``ahead`` tells how far y begins after x, so that no token is matched with itself."""
    shift = np.array(shifts, np.int64)
    k, first, end = equal_runs(x, y, np.array([0, len(x)]), np.array([0, len(y)]), np.zeros(len(shift), np.int64), shift, span)
    return _with_near(x, y, zip(shift[k].tolist(), first.tolist(), end.tolist(), strict=True), span, similarity, ahead)


def _with_near(x: np.ndarray, y: np.ndarray, equal: Iterable[tuple[int, int, int]], span: int, similarity: float | None, ahead: int | None) -> list[tuple[int, int, int, int, float]]:
    """``shared_runs`` of a pair whose equal stretches are (shift, first, end)."""
    out = []
    covered = np.zeros(len(y), bool)
    for s, b, e in equal:
        if not covered[b + s : e + s].all():
            covered[b + s : e + s] = True
            out.append((b, e - 1, b + s, e - 1 + s, 1.0))
    if similarity is None or not len(x) or covered.all():
        return out
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    place = np.minimum(np.searchsorted(ranked, y), len(x) - 1)
    hit, match = ranked[place] == y, order[place]
    if ahead is not None:
        hit &= np.arange(len(y)) + ahead - match >= span + WIDTH - 1
    held = np.flatnonzero(hit)
    if len(held) < similarity * span or covered[held].all():
        return out
    at = match[held]
    # where no token repeats and none is barred, each match is one token of both sets
    plain = ahead is None and not (ranked[1:] == ranked[:-1]).any() and len(np.unique(at)) == len(at)
    if plain:
        rest = np.sort(y[~hit])
        plain = not (rest[1:] == rest[:-1]).any()
    if not plain:
        code = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
        of_x, of_y, codes = code[: len(x)], code[len(x) :], int(code.max()) + 1

    def near(i: int, j: int) -> tuple[int, int, int, int, float] | None:
        b, e = int(held[i]), int(held[j])
        if e - b + 1 < span or covered[b : e + 1].all():
            return None
        p, q = int(at[i : j + 1].min()), int(at[i : j + 1].max())
        if q - p + 1 < span:
            return None
        if plain:
            both, whole = j - i + 1, q - p + e - b + 2
        else:
            u, w = np.zeros(codes, bool), np.zeros(codes, bool)
            u[of_x[p : q + 1]] = True
            w[of_y[b : e + 1]] = True
            both, whole = int(np.count_nonzero(u & w)), int(np.count_nonzero(u) + np.count_nonzero(w))
        share = both / (whole - both)
        return (p, q, b, e, share) if share >= similarity else None

    cut = np.flatnonzero(np.diff(held) > GAP) + 1
    begin, end = np.append(0, cut), np.append(cut, len(held)) - 1
    long = held[end] - held[begin] + 1 >= span
    for i, j in zip(begin[long].tolist(), end[long].tolist(), strict=True):
        if found := near(i, j):
            covered[found[2] : found[3] + 1] = True
            out.append(found)
    # m matches in stretches of l and k tokens suffice if (1 + similarity) m >= similarity (l + k): a
    # difference of g between the ends. The last end that suffices follows from the maxima from each on.
    g = (1 + similarity) * np.arange(len(held)) - similarity * (held + at)
    high = np.maximum.accumulate(g[::-1])[::-1]
    far = len(held) - 1 - np.searchsorted(high[::-1], g + similarity - 1 - 1e-9)
    todo = np.flatnonzero((held[np.maximum(far, 0)] - held + 1 >= span) & (far >= 0))
    if not len(todo):
        return out
    grows = todo[far[todo] > np.concatenate([[-1], np.maximum.accumulate(far[todo])[:-1]])]
    found = [near(i, int(far[i])) for i in covering(held[grows], held[far[grows]], grows)]
    if None in found:
        # repeated tokens misled the counts, or the stretch lies in passages: from every few tokens on, the
        # longest stretch of a few spans, so that time stays in proportion to the text
        most, then, found = -1, 0, []
        reach = np.searchsorted(held, held[todo] + 4 * span, side="right")
        for i, begins, upto in zip(todo.tolist(), held[todo].tolist(), reach.tolist(), strict=True):
            if begins < then:
                continue
            then = begins + STRIDE
            good = np.flatnonzero(g[i + 1 : upto] >= g[i] + similarity - 1 - 1e-9)
            j = i + 1 + int(good[-1]) if len(good) else i
            if j > most and (one := near(i, j)):
                most = j
                found.append(one)
        found = [found[k] for k in covering([f[2] for f in found], [f[3] for f in found], range(len(found)))]
    out += found
    return out


COLUMNS = ["doc_id", "start_word", "end_word", "rep_doc_id", "rep_start_word", "rep_end_word", "similarity"]


def verified(batches: Iterator[pa.RecordBatch], span: int, similarity: float, near_too: bool) -> Iterator[pa.RecordBatch]:
    """Passages of each pair of regions: equal ones along its shifts, and near ones if ``near_too`` is set or
    the pair has no shifts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, a_lo, _, b, b_lo, _ = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        x, x_at = _tokens(batch.column(7))
        y, y_at = _tokens(batch.column(8))
        many = batch.column(6).value_lengths().to_numpy(zero_copy_only=False)
        pair = np.repeat(np.arange(batch.num_rows), many)
        shift = batch.column(6).flatten().to_numpy(zero_copy_only=False) + (a_lo - b_lo)[pair]
        k, first, end = equal_runs(x, y, x_at, y_at, pair, shift, span)
        edge = np.searchsorted(pair[k], np.arange(batch.num_rows + 1)).tolist()
        equal = list(zip(shift[k].tolist(), first.tolist(), end.tolist(), strict=True))
        rows = []
        for n, (i, i_lo, j, j_lo, shifts, s, e, t, f) in enumerate(zip(a.tolist(), a_lo.tolist(), b.tolist(), b_lo.tolist(), many.tolist(), x_at[:-1].tolist(), x_at[1:].tolist(), y_at[:-1].tolist(), y_at[1:].tolist(), strict=True)):
            near = similarity if near_too or not shifts else None
            if near is None and edge[n] == edge[n + 1]:
                continue
            u, w = x[s:e], y[t:f]
            for p, q, c, d, share in _with_near(u, w, equal[edge[n] : edge[n + 1]], span, near, j_lo - i_lo if i == j else None):
                alike = share == 1 and np.array_equal(u[p : q + 1], w[c : d + 1])
                rows.append((j, j_lo + c, j_lo + d + WIDTH, i, i_lo + p, i_lo + q + WIDTH, share, alike))
        if rows:
            kinds = [pa.int64()] * 6 + [pa.float64(), pa.bool_()]
            columns = zip(*dict.fromkeys(rows), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[*COLUMNS, "equal"])


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a binary column, and where each row's begin, with the end."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    tokens = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return (tokens if tokens.ctypes.data % 8 == 0 else tokens.copy()).view(np.uint64), (at - at[0]) // 8


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, hashes: int = HASHES, enough: int = ENOUGH, similarity: float = SIMILARITY) -> DataFrame:
    """One row per passage of at least span + 4 words that a document shares with another:
    (doc_id, start_word, end_word, rep_doc_id, rep_start_word, rep_end_word, similarity).

    Words count from 0, ends are exclusive. Every occurrence names one representative, the occurrence
    in the smallest doc_id that it was found with; the representative has a row that names itself, and
    later occurrences in its own document have rows that name it. Every span of span + 4 words that two
    documents hold alike lies in a passage of each.
    similarity is the Jaccard similarity of the occurrences' five-word shingles, at least
    ``similarity``. An exact stretch inside a longer near one has a row of its own. An exact passage is
    found under every hash function; one at the threshold 0.8 is found under 2 of 6 with probability
    0.998 if its first partner is near, and under 3 of 6 with probability 0.98 if only later ones are.
    Null, empty and shorter texts share nothing, nor do rows
    with a null id. Rows that repeat an id with other texts are documents of their own, also against each
    other, and all go by that id; a row that repeats id and text counts once. Other columns are ignored.

    Plan: windows of two hash functions at a time are written (24 bytes a row). A pre-aggregated grouping finds shared minima;
    a sort-merge join, which Spark splits where a passage is hot, brings them to the windows. One
    shuffle brings texts to the regions in question; regions, not texts, meet each other. The documents
    with spans left over are read once more.
    """
    ship(docs.sparkSession)
    if not 8 <= span <= 250 or hashes > 8:
        raise ValueError("span must be 8 to 250 and hashes at most 8")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # ids are counted from their column alone; only tables that repeat some pay for telling them apart
    repeated = written(texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    if not repeated.isEmpty():
        return _apart(texts, repeated, span, hashes, enough, similarity)
    return _shared(texts, span, hashes, enough, similarity)


def _apart(texts: DataFrame, repeated: DataFrame, span: int, hashes: int, enough: int, similarity: float) -> DataFrame:
    """Passages of texts some of whose ids repeat: each of their texts but one gets a number of its own,
    beyond all ids, by its hash, and its id back at the end."""
    again = texts.join(repeated, "id", "left_semi").withColumn("h", F.xxhash64("id", "text")).dropDuplicates(["id", "h"])
    first = again.groupBy("id").agg(F.min("h").alias("first"))
    made = F.lit(1 << 62) + F.shiftrightunsigned("h", 2)
    known = written(again.join(first, "id").where("h <> first").select(made.alias("made"), "id"), "made")
    top = texts.agg(F.max("id")).first()[0]
    if top >= 1 << 62:
        raise ValueError("ids that repeat must be below 2**62")
    rest = texts.join(repeated, "id", "left_anti")
    numbered = again.join(first, "id").select(F.when(F.col("h") == F.col("first"), F.col("id")).otherwise(made).alias("id"), "text")
    found = _shared(rest.unionByName(numbered), span, hashes, enough, similarity)
    for c in ("doc_id", "rep_doc_id"):
        name = known.select(F.col("made").alias(c), F.col("id").alias("of"))
        found = found.join(name, c, "left").withColumn(c, F.coalesce("of", c)).drop("of")
    return found.select(COLUMNS).distinct()


def _shared(texts: DataFrame, span: int, hashes: int, enough: int, similarity: float) -> DataFrame:
    """``shared_passages`` of (id, text) without repeated ids."""
    parts = []
    for k in range(0, hashes, AT_ONCE):
        functions = range(k, min(k + AT_ONCE, hashes))
        w = written(texts.mapInArrow(lambda it, functions=functions: windows(it, span, functions), "key long, id long, pos long"), "windows")
        busy = w.groupBy("key").agg(F.min(F.struct("id", "pos")).alias("f"), F.max("id").alias("top")).where("f.id < top")
        busy = written(busy.select("key", F.col("f.id").alias("a"), F.col("f.pos").alias("apos")), "shared")
        parts.append(written(w.join(busy.hint("merge"), "key"), "met"))
        dropped(w, busy)
    met = reduce(DataFrame.union, parts).groupBy("id").agg(F.collect_list(F.struct("key", "pos", "a", "apos")).alias("m"))
    met = written(met, "met")
    dropped(*parts)
    shared = met.select("id", F.explode("m").alias("m")).where(F.col("m.key").bitwiseAND(7) == 0).select("m.key", "id", "m.pos")
    pairs = written(met.mapInArrow(lambda it: supported(it, span, enough), PAIR), "regions")
    found = _passages(texts, pairs, span, similarity, True)

    # a representative's side of a passage is matched as well
    equal = found.where("equal")
    sides = found.select("doc_id", "start_word", "end_word", "equal", F.lit(False).alias("rep")).union(found.select(*COLUMNS[3:6], "equal", F.lit(True)))
    held = sides.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"), "equal", "rep")).alias("found"))
    rest = met.join(held, "id", "left").select("id", "m", "found").mapInArrow(lambda it: left_over(it, span, hashes), f"{CELL}, minima array<long>")
    rest = written(rest, "unmatched")
    free = rest.where(F.col("kind") == EQUAL).select("key", "id", "lo", "hi")
    near = written(_near_pairs(rest, span), "near")
    # a span may be left over in one document only: its equals elsewhere are then matched, each with a
    # representative's equal span, so that the representatives' windows stand for all of them
    c = F.shiftright("pos", 16)
    start, stop = c - F.shiftright("pos", 8).bitwiseAND(255), c + F.col("pos").bitwiseAND(255) - span + 2
    of_reps = shared.hint("merge").join(free.select("key").distinct(), "key", "left_semi").join(equal.select(F.col("rep_doc_id").alias("id")).distinct(), "id", "left_semi")
    runs = free.select("id", "lo", "hi").union(of_reps.select("id", start.alias("lo"), stop.alias("hi")))
    runs = written(runs.groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")), "runs")
    dropped(met, rest)
    left = texts.join(runs, "id").select("id", "text", "runs")
    left = written(left.mapInArrow(lambda it: whole_spans(it, span), "key long, id long, at long"), "spans")
    groups = left.groupBy("key").agg(F.min(F.struct("id", "at")).alias("f"), F.max("id").alias("top"), F.count("*").alias("n")).where("n > 1")
    # of one document only, but inside a passage that it represents for another: shared all the same
    alone = left.join(groups.where("f.id = top").select("key"), "key", "left_semi").alias("l")
    shown = equal.where("doc_id <> rep_doc_id").select(F.col("rep_doc_id").alias("id"), F.col("rep_start_word").alias("s"), F.col("rep_end_word").alias("e")).distinct().alias("p")
    inside = (F.col("l.id") == F.col("p.id")) & (F.col("l.at") >= F.col("p.s")) & (F.col("l.at") + (span + WIDTH - 1) <= F.col("p.e"))
    known = alone.join(shown, inside, "left_semi").select("key").distinct().withColumn("known", F.lit(True))
    lead = groups.join(known, "key", "left").where("f.id < top or known").select("key", F.col("f.id").alias("a"), F.col("f.at").alias("a_at"))
    # a span that repeats in the leader document may overlap its first occurrence there
    more = left.join(lead, "key").where((F.col("id") != F.col("a")) | (F.col("at") != F.col("a_at")))
    # starts of one document that follow each other at one shift make one region
    block = F.floor(F.col("at") / (8 * span))
    more = more.withColumn("shift", F.col("at") - F.col("a_at")).groupBy("a", "id", "shift", block).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    begin, end = F.col("lo") - span, F.col("hi") + 2 * span
    zero = F.lit(0).cast("long")
    more = more.select("a", F.greatest(zero, begin - F.col("shift")).alias("a_lo"), (end - F.col("shift")).alias("a_hi"), F.col("id").alias("b"), F.greatest(zero, begin).alias("b_lo"), end.alias("b_hi"), F.array("shift").alias("shifts"))
    more = written(more.union(near), "regions")
    dropped(left, runs, near)
    found = written(_joined(found.union(_passages(texts, more, span, similarity, False))), "passages")
    rep = [F.col(c) for c in COLUMNS[3:6]]
    return found.union(found.select(*rep, *rep, F.lit(1.0)).distinct())


def _near_pairs(rest: DataFrame, span: int) -> DataFrame:
    """Regions of runs of spans that lie in no passage yet, each with the leader of its combinations of
    minima. A combination's two leaders, of those that seek and of those in passages, are drawn by a hash,
    so that texts which share many of them meet more than one other; each run makes two rows a combination
    at most, however many documents hold it. Runs in passages make rows for combinations only that some
    run seeks, as a bit table of fixed size tells; a bit set by chance costs work, not results."""
    seek = rest.where(F.col("kind") == SEEKS).drop("minima")
    bits = rest.sparkSession.sparkContext.broadcast(bit_table(seek.select(F.col("key").alias("h"))))
    cells = seek.union(rest.where(F.col("kind") == LEADS).select("id", "lo", "hi", "minima").mapInArrow(lambda it: sought(it, bits.value), CELL))
    drawn = F.struct(F.xxhash64("key", "id").alias("h"), "id", "lo", "hi")
    of = lambda kind: F.min(F.when(F.col("kind") == kind, drawn))
    lead = cells.groupBy("key").agg(of(SEEKS).alias("s"), of(LEADS).alias("l"), F.count("*").alias("n")).where("n > 1 and s is not null")
    lead = lead.select("key", F.explode(F.array_compact(F.array("s", "l"))).alias("f")).select("key", F.struct("f.id", "f.lo", "f.hi").alias("f"))
    one = cells.where(F.col("kind") == SEEKS).hint("merge").join(lead, "key").select(F.struct("id", "lo", "hi").alias("s"), "f")
    one = one.where((F.col("s.id") != F.col("f.id")) | (F.abs(F.col("s.lo") - F.col("f.lo")) >= span + WIDTH - 1)).distinct()
    one = one.select(F.least("s", "f").alias("a"), F.greatest("s", "f").alias("b"))
    side = [F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.floor(F.col("b.lo") / (8 * span)).alias("block"), F.floor((F.col("b.lo") - F.col("a.lo")) / (2 * span)).alias("shift")]
    low = [F.min(f"{x}.lo").alias(f"{x}_lo") for x in "ab"] + [F.max(f"{x}.hi").alias(f"{x}_hi") for x in "ab"]
    out = one.groupBy(*side).agg(*low)
    # a span and what it may reach over: most of these pairs are alike by chance, and tokens are what travels
    begin = lambda x: F.greatest(F.lit(0).cast("long"), F.col(x) - GAP)
    end = lambda x: F.col(x) + (span + GAP)
    return out.select("a", begin("a_lo").alias("a_lo"), end("a_hi").alias("a_hi"), "b", begin("b_lo").alias("b_lo"), end("b_hi").alias("b_hi"), F.array().cast("array<long>").alias("shifts"))


def _joined(found: DataFrame) -> DataFrame:
    """Equal stretches that regions cut: those that overlap at one shift are one."""
    near = found.where("not equal").select(COLUMNS).distinct()
    same = Window.partitionBy("doc_id", "rep_doc_id", "shift").orderBy("start_word", "end_word")
    upto = F.max("end_word").over(same.rowsBetween(Window.unboundedPreceding, -1))
    whole = found.where("equal").withColumn("shift", F.col("start_word") - F.col("rep_start_word"))
    whole = whole.withColumn("new", F.coalesce((F.col("start_word") > upto).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(same))
    whole = whole.groupBy("doc_id", "rep_doc_id", "shift", "run").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    whole = whole.withColumns({"rep_start_word": F.col("start_word") - F.col("shift"), "rep_end_word": F.col("end_word") - F.col("shift"), "similarity": F.lit(1.0)})
    return near.union(whole.select(COLUMNS))


CELL = "kind long, key long, id long, lo long, hi long"
PAIR = "a long, a_lo long, a_hi long, b long, b_lo long, b_hi long, shifts array<long>"


def _passages(texts: DataFrame, pairs: DataFrame, span: int, similarity: float, near_too: bool) -> DataFrame:
    """Passages in pairs of regions, a written table, as ``verified`` finds them. The table of pairs is gone
    afterwards.

    Most pairs are alike by chance. So the first 16 bits of the tokens meet first, and the tokens themselves
    travel only for pairs that hold as many equal ones as the shortest passage at the threshold needs."""
    spark = texts.sparkSession
    regions = pairs.select(F.col("a").alias("id"), F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")).union(pairs.select("b", "b_lo", "b_hi")).distinct()
    # a long document's regions are dealt over rows by their place, so that they don't become one long list
    regions = regions.groupBy("id", F.floor(F.col("lo") / BLOCK).alias("part")).agg(F.collect_list(F.struct("lo", "hi")).alias("regions")).select("id", "regions")
    # ids are unique and regions distinct, hence the excerpts are
    cut = texts.hint("merge").join(regions, "id").select("id", "text", "regions").mapInArrow(excerpts, "id long, lo long, hi long, tokens binary, prints binary")
    cut = written(cut, "excerpts")
    released(spark)

    def met(pairs: DataFrame, cut: DataFrame, column: str) -> DataFrame:
        side = lambda p, name: cut.select(F.col("id").alias(p), F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"), F.col(column).alias(name))
        return pairs.join(side("a", "x"), ["a", "a_lo", "a_hi"]).join(side("b", "y"), ["b", "b_lo", "b_hi"]).select(*pairs.columns, "x", "y")

    close = written(met(pairs, cut, "prints").mapInArrow(lambda it: alike(it, similarity * span), PAIR), "alike")
    dropped(pairs)
    key = F.xxhash64("id", "lo", "hi")
    wanted = close.select(F.explode(F.array(*(F.struct(F.col(p).alias("id"), F.col(f"{p}_lo").alias("lo"), F.col(f"{p}_hi").alias("hi")) for p in "ab"))).alias("r")).select("r.*")
    bits = spark.sparkContext.broadcast(bit_table(wanted.select(key.alias("h"))))
    kept = cut.select(key.alias("h"), "id", "lo", "hi", "tokens").mapInArrow(lambda it: named(it, bits.value), "id long, lo long, hi long, tokens binary")
    out = met(close, kept, "tokens").mapInArrow(lambda it: verified(it, span, similarity, near_too), "doc_id long, start_word long, end_word long, rep_doc_id long, rep_start_word long, rep_end_word long, similarity double, equal boolean")
    out = written(out, "passages")
    dropped(close, cut)
    return out
