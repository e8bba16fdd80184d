"""Packing documents into training sequences along a space-filling curve.

A document's token counts, hashed into a fixed number of buckets, are projected to a few dimensions; its
place on the Hilbert curve through these is its key, so that documents with similar words get keys close
together. The documents are sorted by ranges of the key, laid end to end along the curve, and cut every
``LENGTH`` tokens: neighbours on the curve share a sequence. What is left at the end is cut into powers
of two, so that no token of padding is needed.

Ids are made once, in one pass over the texts, and written; they travel once, to the range of their key.
The driver sees the ranges' bounds and sizes, whose number is that of the shuffle's partitions.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from ._store import written
from ._words import LOWER, SPACE, mix, spans, utf8

#: Fixed values of the contract: tokens of a sequence, the id that ends a document.
LENGTH, END = 4096, 2
#: Buckets of the hashed vectors; dimensions and bits of each that the curve goes through. The key's
#: remaining bits deal out documents of one place, such as copies.
BUCKETS, DIMENSIONS, BITS = 1024, 4, 10
TIE_BITS = 63 - DIMENSIONS * BITS
#: Bytes of text that are encoded at once, ranges for each shuffle partition, and pieces of text that
#: a worker remembers in each half of its memory (twice as many at most), none longer than LONG.
AT_ONCE, RANGES, REMEMBERED, LONG = 1 << 23, 4, 200_000, 64

EASY = re.compile("[a-zß-öø-ÿ]+")
LETTER, SIGN = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
SIGN[[c for c in range(0x21, 0x7F) if not LETTER[c] and not 0x30 <= c <= 0x39 and c != ord("'")]] = True


def axes(seed: int = 12) -> np.ndarray:
    """A direction for each dimension among the buckets, from hashes alone."""
    n = np.arange(BUCKETS * DIMENSIONS, dtype=np.uint64) + np.uint64(seed << 32)
    u = (mix(n * np.uint64(0x9E3779B97F4A7C13)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return ((u - 0.5) * np.sqrt(12.0)).reshape(BUCKETS, DIMENSIONS)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates (unsigned, ``bits`` bits each)."""
    x = x.astype(np.int64).T.copy()  # one row a dimension
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of ever smaller cubes
        low = q - 1
        for i in range(len(x)):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):  # the dimensions' bits in turns
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, size: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Hilbert key of each document; ``ids``: of all, one after the other, ``size`` of each."""
    if not len(size):
        return np.zeros(0, np.int64)
    bucket = (mix(ids.astype(np.uint64) + np.uint64(1)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    grid = np.zeros((len(size), DIMENSIONS), np.int64)
    ends = np.cumsum(size)
    for lo in range(0, len(size), 256):
        hi = min(lo + 256, len(size))
        first, last = ends[lo] - size[lo], ends[hi - 1]
        row = np.repeat(np.arange(hi - lo), size[lo:hi])
        counts = np.bincount(row * BUCKETS + bucket[first:last], minlength=(hi - lo) * BUCKETS).reshape(hi - lo, BUCKETS)
        v = np.log1p(counts)
        v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
        # about standard normal in each direction; 4 deviations either side fill the grid
        grid[lo:hi] = np.clip((v @ directions + 4.0) * (1 << BITS) / 8.0, 0, (1 << BITS) - 1)
    return hilbert(grid, BITS)


class Encoder:
    """The tokenizers library's ids of many texts at once; each distinct piece is encoded once.

    Texts are cut at white space and between letters and signs, where this tokenizer's normalizer and
    pattern never look across; texts that hold an added token's string are given to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = [b for b in range(256) if b not in plain]
        #: the model's printable stand-ins of bytes
        self.stands = {b: 256 + i for i, b in enumerate(rest)}
        self.simple = self._plain_model()

    def _plain_model(self) -> bool:
        """Whether one lower-case word may go to the model itself: so it does if both agree on samples."""
        words = ["a", "words", "zqxj", "été", "über", "ñandú", "schön"]
        try:
            return all([t.id for t in self.tokenizer.model.tokenize(self._stand(w))] == self._whole([w])[0] for w in words)
        except Exception:  # noqa: BLE001  another kind of model
            return False

    def _stand(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.stands)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def new(self, words: list[str]) -> list[bytes]:
        # letters of ASCII and of the two bytes C3 9F to C3 BF without the division sign are as they are
        ascii_ = [w.isascii() and w.isalpha() for w in words]
        easy = [self.simple and (a or EASY.fullmatch(w) is not None) for w, a in zip(words, ascii_, strict=True)]
        hard = iter(self._whole([w for w, e in zip(words, easy, strict=True) if not e]))
        one, stand = self.tokenizer.model.tokenize, self._stand
        return [array("I", [t.id for t in one(w if a else stand(w))] if e else next(hard)).tobytes() for w, a, e in zip(words, ascii_, easy, strict=True)]

    def pieces(self, words: list[str]) -> list[bytes]:
        found = list(map(self.known.get, words))
        missing = [i for i, f in enumerate(found) if f is None]
        if not missing:
            return found
        names = [words[i] for i in missing]
        ids = list(map(self.older.get, names))
        fresh = [k for k, f in enumerate(ids) if f is None]
        for k, f in zip(fresh, self.new([names[k] for k in fresh]), strict=True):
            ids[k] = f
        for i, f in zip(missing, ids, strict=True):
            found[i] = f
        for lo in range(0, len(names), REMEMBERED):
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            part = slice(lo, lo + REMEMBERED)
            self.known.update([(w, f) for w, f in zip(names[part], ids[part], strict=True) if len(w) < LONG])
        return found

    def many(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of adjacent texts without added tokens' strings, index of each text's first id and the
        total). ``data``: their bytes; ``starts``: of each text, ascending."""
        low = LOWER[data]
        gap = SPACE[low]
        cut = np.zeros(len(low) + 1, bool)
        cut[starts] = True
        if len(low) > 1:
            letter = LETTER[low]
            letter[1:] |= (low[:-1] == 0xC3) & (low[1:] >= 0x9F) & (low[1:] != 0xB7)  # ends in such a letter
            head = LETTER[low]
            head[:-1] |= (low[:-1] == 0xC3) & (low[1:] != 0x97) & (low[1:] != 0xB7)
            sign = SIGN[low]
            cut[1:-1] |= gap[:-1] | (letter[:-1] & sign[1:]) | (sign[:-1] & head[1:])
        inside = ~gap
        begin = inside.copy()
        begin[1:] &= gap[:-1] | cut[1:-1]
        begin = np.flatnonzero(begin)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(starts) + 1, np.int64)
        upto = np.cumsum(inside, dtype=np.int32)
        offsets = np.append(upto[begin] - 1, upto[-1])
        words = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])]).dictionary_encode()
        found = self.pieces([w.decode("utf-8", "replace") for w in words.dictionary.cast(pa.binary()).to_pylist()])
        which = words.indices.to_numpy(zero_copy_only=False)
        size = np.array([len(f) for f in found], np.int64) >> 2
        every, own = np.frombuffer(b"".join(found), np.uint32), size[which]
        upto = np.concatenate([[0], np.cumsum(own)])
        first = (np.cumsum(size) - size)[which]
        flat = every[np.repeat(first - upto[:-1], own) + np.arange(upto[-1])]
        return flat, upto[np.searchsorted(begin, np.append(starts, len(low)))]


def stretches(data: np.ndarray, at_once: int) -> Iterator[np.ndarray]:
    """A long text cut at white space into stretches of about ``at_once`` bytes."""
    lo = 0
    while len(data) - lo > 2 * at_once:
        cut = np.flatnonzero(SPACE[data[lo + at_once : lo + 2 * at_once]])
        step = at_once + (int(cut[0]) if len(cut) else at_once)
        if not len(cut):  # no white space for long: to the next, wherever it is
            far = np.flatnonzero(SPACE[data[lo + step :]])
            step = step + int(far[0]) if len(far) else len(data) - lo
        yield data[lo : lo + step]
        lo += step
    yield data[lo:]


_encoder: tuple[str, Encoder] | None = None


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, key, n, ids)."""
    global _encoder
    if _encoder is None or _encoder[0] != path:
        _encoder = (path, Encoder(path))
    coder, directions = _encoder[1], axes()
    last = np.array([end], np.uint32)
    for batch in batches:
        texts = batch.column(1)
        odd = np.zeros(len(texts), bool)
        for token in coder.added:
            odd |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        raw, starts, ends = utf8(texts)
        same = batch.column(0).to_pandas()
        nth = same.groupby(same, dropna=False, sort=False).cumcount().to_numpy()  # rows of one id part as well
        for lo, hi in spans(starts, ends, AT_ONCE, rows=1 << 20):
            if odd[lo:hi].any() or ends[hi - 1] - starts[lo] > 2 * AT_ONCE:
                parts = []
                for i in range(lo, hi):
                    if odd[i]:
                        parts.append(np.array(coder._whole([raw[starts[i] : ends[i]].tobytes().decode("utf-8", "replace")])[0], np.uint32))
                    else:
                        parts.append(np.concatenate([coder.many(s, np.zeros(1, np.int64))[0] for s in stretches(raw[starts[i] : ends[i]], AT_ONCE)]))
            else:
                size = ends[lo:hi] - starts[lo:hi]
                data = raw[starts[lo] : ends[hi - 1]] if size.sum() == ends[hi - 1] - starts[lo] else np.concatenate([raw[s:e] for s, e in zip(starts[lo:hi], ends[lo:hi], strict=True)])
                flat, at = coder.many(data, np.cumsum(size) - size)
                parts = [flat[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
            parts = [np.concatenate([p, last]) for p in parts]
            size = np.array([len(p) for p in parts], np.int64)
            flat = np.concatenate(parts)
            place = curve_keys(flat, size, directions)
            offsets = np.concatenate([[0], np.cumsum(4 * size)])
            ids = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).cast(pa.binary())
            columns = [batch.column(0).slice(lo, hi - lo), pa.array(place), pa.array(nth[lo:hi], pa.int64()), pa.array(size), ids]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "place", "nth", "n", "ids"])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tails(total: int, length: int) -> list[int]:
    """Where the sequences of the last, incomplete stretch begin: powers of two, longest first."""
    at, out = total - total % length, []
    for b in range(length.bit_length() - 1, -1, -1):
        if (total % length) >> b & 1:
            out.append(at)
            at += 1 << b
    return out


def packed(docs: DataFrame, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """One row a piece: (id, start, length, doc_tokens, sequence_id, offset, ids).

    start: the document's tokens before the piece; offset: the piece's place in its sequence; ids: the
    piece's ids, little-endian unsigned 32-bit integers. Sequence s holds the tokens from s * length on
    along the curve; all are full but the last few, which are powers of two long. A null text counts as
    empty; an empty one is its end token alone. Repeated rows are documents of their own; rows of one id
    may change places. An empty table has no pieces. Other columns are ignored.

    A document of any length is cut freely; a range holds a document whole, so memory is bounded by the
    longest document. Copies share a place on the curve: the low bits of the key deal them out.
    """
    spark = docs.sparkSession
    ship(spark)
    path = vocabulary_path or default_vocabulary()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(lambda it: encoded(it, path, end), f"id {kind}, place long, nth long, n long, ids binary")
    tie = F.pmod(F.xxhash64("id", "nth"), F.lit(1 << TIE_BITS))
    made = written(made.select("id", (F.shiftleft("place", TIE_BITS) + tie).alias("key"), "n", "ids"), "ids")
    many = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = made.agg(F.percentile_approx("key", [k / many for k in range(1, many)], 20 * many)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="left").astype(np.int32))

    sizes = sorted(tuple(r) for r in made.select("n", range_of("key").alias("part")).groupBy("part").agg(F.sum("n")).collect())
    before, total = {}, 0
    for part, n in sizes:
        before[part] = total
        total += n
    ends = tails(total, length)
    full = total - total % length
    first = F.element_at(F.create_map(*[F.lit(x).cast("long") for p in before.items() for x in p]), F.col("part").cast("long")) if before else F.lit(0).cast("long")
    order = Window.partitionBy("part").orderBy("key", "id")
    d = made.withColumn("part", range_of("key")).withColumn("stop", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) + first)
    d = d.withColumn("begin", F.col("stop") - F.col("n"))
    step, last = F.lit(length).cast("long"), F.array(*[F.lit(e).cast("long") for e in ends[1:]]).cast("array<bigint>")
    lo, hi = F.floor(F.col("begin") / step).cast("long") + 1, F.floor((F.col("stop") - 1) / step).cast("long")
    inner = F.when(lo <= hi, F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda k: k * step)).otherwise(F.array().cast("array<bigint>"))
    inner = F.concat(inner, F.filter(last, lambda e: (e > F.col("begin")) & (e < F.col("stop"))))
    d = d.withColumn("cuts", F.concat(F.array("begin"), inner))
    d = d.withColumn("pieces", F.transform("cuts", lambda c, i: _piece(c, F.coalesce(F.get("cuts", i + 1), F.col("stop")), full, length, ends)))
    out = d.select("id", "n", F.explode("pieces").alias("p"))
    return out.select(F.col("id").alias(id_col), "p.start", "p.length", F.col("n").alias("doc_tokens"), "p.sequence_id", "p.offset", "p.ids")


def _piece(at: Column, to: Column, full: int, length: int, ends: list[int]) -> Column:
    """The piece from token ``at`` to token ``to`` of the curve, with its sequence."""
    start = at - F.col("begin")
    tail = F.array(*[F.lit(e).cast("long") for e in ends]).cast("array<bigint>")
    passed = F.filter(tail, lambda e: e <= at)
    late = (at >= full) & (F.size(passed) > 0)
    sequence = F.when(late, F.lit(full // length) + F.size(passed) - 1).otherwise(F.floor(at / F.lit(length)))
    offset = F.when(late, at - F.element_at(passed, -1)).otherwise(at % F.lit(length))
    ids = F.substring("ids", (4 * start + 1).cast("int"), (4 * (to - at)).cast("int"))
    return F.struct(start.alias("start"), (to - at).alias("length"), sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"), ids.alias("ids"))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of each sequence, from ``packed``; at most its length in one group."""
    runs = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("runs"))
    return runs.select("sequence_id", "length", F.aggregate(F.col("runs.ids"), F.lit(b""), lambda acc, x: F.concat(acc, x)).alias("ids"))


def packing(spark: SparkSession, docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Pieces with the checksums of their ids in place of these."""
    p = packed(docs, vocabulary_path)
    return p.select(p.columns[0], "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
