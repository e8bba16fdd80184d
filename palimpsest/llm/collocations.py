"""Phrase collocations from weighted acyclic automata.

A shard's n-grams, sorted, become a count transducer: a deterministic acyclic automaton whose arcs are
words and whose states carry the number of occurrences of the path that leads to them. It is built level
by level, each level from the sorted arcs that leave the level before. Shards are cut by prefix range
(the first two words), and each range's automata are united: equal paths become one, their weights are
added. A path's own states give the counts of its first parts; composing the rests of all candidates
with the united automata, a join on the common words, gives the counts of the last parts.

Only paths that can matter are built: every part of a phrase with ``least`` occurrences has as many
itself. So words are counted first, then pairs of frequent words, then phrases whose pairs are all
frequent. What is frequent goes from one pass to the next as a bit table of fixed size; a bit that is set
by chance costs work, not results. All counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ._store import written
from ._words import BASE, BYTE, LOWER, STEP, U, mix, powers, spans, utf8

#: Fixed values of the contract: occurrences of a candidate, words of the longest, rows of each language.
LEAST, MOST_WORDS, TOP = 100, 5, 2000
#: Bytes of text that become one shard, states that are united at once, bits of the table of what is frequent, salts of a ranking.
SHARD, AT_ONCE, BITS, SALTS = 6 << 20, 1 << 20, 1 << 25, 64

BLANK, BREAK = np.zeros(256, bool), np.zeros(256, bool)
BLANK[[32, 9]] = True
BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True

WORD_ROW = "lang string, word string, n long"
SHARD_ROW = "range int, lang string, states int, automaton binary"
PHRASE_ROW = "lang string, phrase string, words int, f long, prefix array<bigint>, h long"


def hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word's bytes."""
    raw, starts, ends = utf8(words)
    size = ends - starts
    if not size.sum():
        return mix(size.astype(np.uint64) * STEP)
    data = raw[starts[0] : ends[-1]]
    place = np.arange(len(data)) - np.repeat(starts - starts[0], size)
    value = np.concatenate([[U(0)], np.cumsum(BYTE[data] * powers(int(size.max()))[place])])
    return mix(value[ends - starts[0]] - value[starts - starts[0]] + size.astype(np.uint64) * STEP)


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * BASE + b)


def told(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = h & U(BITS - 1)
    return (bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


def cut(data: np.ndarray, starts: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(the words of adjacent texts, each word's text, how many words of its piece begin at or behind it)"""
    low = LOWER[data]
    off = BLANK[low] | BREAK[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[starts] = True
    begin = ~off
    begin[1:] &= off[:-1] | edge[1:-1]
    begin = np.flatnonzero(begin)
    kept = ~off
    upto = np.cumsum(kept) - kept
    offsets = np.append(upto[begin], kept.sum()).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(low[kept])]).dictionary_encode()
    piece = np.cumsum(BREAK[low] | edge[:-1])[begin]
    text = np.searchsorted(starts, begin, side="right") - 1
    last = np.append(np.flatnonzero(np.diff(piece)), len(piece) - 1) if len(piece) else np.zeros(0, np.int64)
    left = last[np.searchsorted(last, np.arange(len(piece)))] - np.arange(len(piece)) + 1
    return words, text, left


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, pa.DictionaryArray, np.ndarray, np.ndarray]]:
    """(languages, words, each word's language, how many words are left in its piece) of about ``size``
    bytes of text at once; a longer text is cut where its pieces end."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        raw, starts, ends = utf8(batch.column(1))
        for lo, hi in spans(starts, ends, size, rows=1 << 20):
            n = ends[lo:hi] - starts[lo:hi]
            if hi == lo + 1 and n[0] > 2 * size:
                data = raw[starts[lo] : ends[lo]]
                stops = np.flatnonzero(BREAK[data])
                stops = stops[np.append(np.diff(stops // size) > 0, True)] if len(stops) else stops
                runs = [(part, np.zeros(1, np.int64)) for part in np.split(data, stops) if len(part)]
            else:
                whole = n.sum() == ends[hi - 1] - starts[lo]
                data = raw[starts[lo] : ends[hi - 1]] if whole else np.concatenate([raw[s:e] for s, e in zip(starts[lo:hi], ends[lo:hi], strict=True)])
                runs = [(data, np.cumsum(n) - n)]
            for data, at in runs:
                if len(data):
                    # of empty texts at one place the last owns what follows
                    words, text, left = cut(data, np.minimum(at, len(data)))
                    yield names, words, lang[lo:hi][text].astype(np.int64), left


def level(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct arcs of a level in order, each occurrence's state, and the states' weights."""
    return np.unique(key, return_inverse=True, return_counts=True)


def folded_in(values: np.ndarray) -> bytes:
    """Unsigned numbers in the fewest bytes each: (width, count, numbers)."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + len(values).to_bytes(8, "little") + values.astype(kind).tobytes()


def unfolded(data: memoryview, at: int) -> tuple[np.ndarray, int]:
    width, n = data[at], int.from_bytes(data[at + 1 : at + 9], "little")
    end = at + 9 + width * n
    return np.frombuffer(data[at + 9 : end], f"u{width}").astype(np.int64), end


def packed(words: pa.Array, depth: np.ndarray, first: np.ndarray, parent: np.ndarray, label: np.ndarray, weight: np.ndarray) -> bytes:
    """An automaton as bytes: its words, then its states level by level, where the arcs that leave one
    state are neighbours, so that only steps between their origins are kept."""
    raw, starts, ends = utf8(words)
    text = raw[starts[0] : ends[-1]].tobytes() if len(words) else b""
    levels = np.bincount(depth, minlength=1)
    origin = np.where(depth == 2, first, parent)
    begins = np.cumsum(levels) - levels
    steps = np.diff(origin, prepend=0)
    some = begins[levels > 0]
    steps[some] = origin[some]
    parts = [folded_in(levels), folded_in(ends - starts), folded_in(np.frombuffer(text, np.uint8)), folded_in(steps), folded_in(label), folded_in(weight - 1)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def opened(automaton: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, depth, origin, label, weight) of ``packed``."""
    data = memoryview(zstandard.ZstdDecompressor().decompress(automaton))
    levels, at = unfolded(data, 0)
    sizes, at = unfolded(data, at)
    n = int.from_bytes(data[at + 1 : at + 9], "little")
    text = data[at + 9 : at + 9 + n]
    steps, at = unfolded(data, at + 9 + n)
    label, at = unfolded(data, at)
    weight, _ = unfolded(data, at)
    depth = np.repeat(np.arange(len(levels)), levels)
    upto = np.cumsum(steps)
    begins = (np.cumsum(levels) - levels)[depth]
    origin = upto - np.where(begins > 0, upto[begins - 1], 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(text)]), depth, origin, label, weight + 1


def roots(names: list, words: pa.DictionaryArray, lang: np.ndarray) -> tuple:
    """The first level of a shard: (words of the dictionary, occurrences' words, arcs, states, weights,
    hashes of the states and of the words)."""
    w, d = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
    arcs, state, weight = level(lang * d + w)
    h, of = hashes(words.dictionary), hashes(pa.array(names, pa.string()))
    return w, d, arcs, state, weight, pair_hashes(of[arcs // d], h[arcs % d]), h


def counted_words(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, word, n) of each shard, and a row without word for all of a language."""
    for names, words, lang, _ in shards(batches, size):
        d = len(words.dictionary)
        arcs, _, weight = level(lang * d + words.indices.to_numpy(zero_copy_only=False))
        n = np.bincount(lang, minlength=len(names))
        some = np.flatnonzero(n)
        langs = pa.array(names, pa.string()).take(pa.array(np.concatenate([arcs // d, some])))
        word = pa.concat_arrays([words.dictionary.take(pa.array(arcs % d)), pa.nulls(len(some), pa.string())])
        yield pa.RecordBatch.from_arrays([langs, word, pa.array(np.concatenate([weight, n[some]]))], names=["lang", "word", "n"])


def word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word) -> h, as ``roots`` has it."""
    for batch in batches:
        h = pair_hashes(hashes(batch.column(0)), hashes(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


def transducers(batches: Iterator[pa.RecordBatch], words_told: np.ndarray, pairs_told: np.ndarray | None, ranges: int, size: int, most: int) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> a shard's count transducer, one row for each language and prefix range.

    States are listed level by level, from paths of two words on; without ``pairs_told`` that level is the
    last.
    """
    for names, words, lang, left in shards(batches, size):
        w, d, arcs, state, _, h1, h = roots(names, words, lang)
        if not len(w):
            continue
        fine = told(h1, words_told)[state]
        at = np.flatnonzero((left[:-1] > 1) & fine[:-1] & fine[1:])
        pair, where, weight = level(state[at] * d + w[at + 1])
        h2 = pair_hashes(h1[pair // d], h[pair % d])
        if pairs_told is not None:
            kept = told(h2, pairs_told)
            at, where = at[kept[where]], (np.cumsum(kept) - 1)[where[kept[where]]]
            pair, weight, h2 = pair[kept], weight[kept], h2[kept]
        if not len(pair):
            continue
        group = arcs[pair // d] // d * ranges + (h2 % U(ranges)).astype(np.int64)
        first, groups, parents, labels, weights, depths = arcs[pair // d] % d, [group], [np.full(len(pair), -1)], [pair % d], [weight], [np.full(len(pair), 2)]
        if pairs_told is not None:
            on = np.zeros(len(w) + most, bool)
            on[at] = True
            before, total = 0, len(pair)
            for k in range(3, most + 1):  # the path goes on where the next pair is frequent as well
                go = on[at + k - 2]
                at, where = at[go], where[go]
                if not len(at):
                    break
                arc, where, weight = level(where * d + w[at + k - 1])
                parents.append(before + arc // d)
                groups.append(groups[-1][arc // d])
                labels.append(arc % d)
                weights.append(weight)
                depths.append(np.full(len(arc), k))
                before, total = total, total + len(arc)
        yield by_range(names, words.dictionary, ranges, first, *map(np.concatenate, (groups, parents, labels, weights, depths)))


def by_range(names: list, dictionary: pa.Array, ranges: int, first: np.ndarray, group: np.ndarray, parent: np.ndarray, label: np.ndarray, weight: np.ndarray, depth: np.ndarray) -> pa.RecordBatch:
    """The automaton's states as one row a group (language and range), each with its own words."""
    d = len(dictionary)
    order = np.argsort(group, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    group, depth, weight = group[order], depth[order], weight[order]
    own, begin, row = np.unique(group, return_index=True, return_inverse=True)
    parent = np.where(parent[order] < 0, -1, rank[parent[order]] - begin[row])
    top = depth == 2
    first = first[order[top]]  # states of two words come first in every list that they came in
    used, place = np.unique(np.concatenate([row * d + label[order], row[top] * d + first]), return_inverse=True)
    word_begin = np.searchsorted(used, np.arange(len(own) + 1) * d)
    place = place - word_begin[np.concatenate([row, row[top]])]
    firsts = np.full(len(order), -1)
    firsts[top] = place[len(order) :]
    ends, place = np.append(begin, len(order)), place[: len(order)]
    rows = []
    for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        its = dictionary.take(pa.array(used[word_begin[k] : word_begin[k + 1]] % d))
        rows.append(packed(its, depth[lo:hi], firsts[lo:hi], parent[lo:hi], place[lo:hi], weight[lo:hi]))
    columns = [pa.array(own % ranges, pa.int32()), pa.array(names, pa.string()).take(pa.array(own // ranges)), pa.array(np.diff(ends), pa.int32()), pa.array(rows, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in SHARD_ROW.split(", ")])


def united(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Automata in the order of (range, lang) -> the frequent paths of their union.

    Rows of a group lie together; whole groups are united as soon as they have states enough."""
    pending: list[pa.RecordBatch] = []
    states = 0
    for batch in batches:
        pending.append(batch)
        states += pa.compute.sum(batch.column(2)).as_py() or 0
        if states >= AT_ONCE:
            table = pa.Table.from_batches(pending).combine_chunks().to_batches()[0]
            keys = list(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
            end = next((i for i in range(len(keys) - 1, 0, -1) if keys[i - 1] != keys[-1]), 0)
            if end:
                yield from union(table.slice(0, end), least)
                pending = [table.slice(end)]
                states = pa.compute.sum(pending[0].column(2)).as_py() or 0
    if pending:
        table = pa.Table.from_batches(pending).combine_chunks().to_batches()
        if table:
            yield from union(table[0], least)


def union(rows: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    """Unites the automata of each (range, lang): level by level, arcs that leave one state with one
    word become one, with the sum of their weights. Yields the paths of at least ``least``."""
    langs = rows.column(1).dictionary_encode()
    lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    each = [opened(a) for a in rows.column(3).to_pylist()]
    if not each:
        return
    words = pa.concat_arrays([a[0] for a in each]).dictionary_encode()
    word, d = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
    depth, origin, label, weight = (np.concatenate([a[k] for a in each]) for k in range(1, 5))
    sizes, word_sizes = np.array([len(a[1]) for a in each]), np.array([len(a[0]) for a in each])
    row = np.repeat(np.arange(len(each)), sizes)
    word_base, base = (np.cumsum(word_sizes) - word_sizes)[row], (np.cumsum(sizes) - sizes)[row]
    label = word[word_base + label]
    merged = np.full(len(row), -1)
    h, of = hashes(words.dictionary), hashes(langs.dictionary)
    phrases, prefix, its_lang = None, None, None
    for k in range(2, int(depth.max(initial=0)) + 1):
        here = np.flatnonzero(depth == k)
        if not len(here):
            break
        if k == 2:
            start = lang[row[here]] * d + word[word_base[here] + origin[here]]
            starts, begin = np.unique(start, return_inverse=True)
            arcs, inverse = np.unique(begin * d + label[here], return_inverse=True)
            source = starts[arcs // d]
            its_lang, text = source // d, words.dictionary.take(pa.array(source % d))
            h2 = pair_hashes(pair_hashes(of[source // d], h[source % d]), h[arcs % d]).view(np.int64)
        else:
            arcs, inverse = np.unique(merged[base[here] + origin[here]] * d + label[here], return_inverse=True)
            up = arcs // d
            its_lang, text, h2 = its_lang[up], phrases.take(pa.array(up)), np.zeros(len(up), np.int64)
            prefix = np.column_stack([prefix[up], total[up]])
        merged[here] = inverse
        total = np.zeros(len(arcs), np.int64)
        np.add.at(total, inverse, weight[here])
        prefix = np.zeros((len(arcs), 0), np.int64) if k == 2 else prefix
        phrases = pa.compute.binary_join_element_wise(text, words.dictionary.take(pa.array(arcs % d)), " ")
        some = np.flatnonzero(total >= least)
        take = pa.array(some)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * (k - 2), pa.int32()), pa.array(prefix[some].ravel(), pa.int64()))
        columns = [langs.dictionary.take(pa.array(its_lang[some])), phrases.take(take), pa.array(np.full(len(some), k), pa.int32()), pa.array(total[some]), lists, pa.array(h2[some])]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in PHRASE_ROW.split(", ")])


def bit_table(frequent: DataFrame) -> np.ndarray:
    """The bits of the hashes ``h``; its size is fixed, whatever the rows."""
    at = F.col("h").bitwiseAND(F.lit(BITS - 1).cast("long"))
    rows = frequent.groupBy(F.floor(at / 32768).cast("int").alias("b")).agg(F.bitmap_construct_agg((at % 32768).cast("int")).alias("bits")).collect()
    table = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        table[r["b"] * 4096 : (r["b"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return table


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, most: int = MOST_WORDS, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f, prefix) of all phrases of 1 to ``most`` words that occur at least
    ``least`` times, (lang, n) with all words of each language).

    prefix: occurrences of the phrase's first 2, 3, .. words. Texts are read in three passes. A range's
    automata meet in one task after each shard has added up its own, so a frequent prefix is one path
    a shard; there are as many ranges as partitions of the shuffle, and languages are united one by one.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = texts.mapInArrow(lambda it: counted_words(it, shard), WORD_ROW).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(counted.where(f"word is null or n >= {int(least)}"), "words")
    frequent = words.where("word is not null")
    words_told = spark.sparkContext.broadcast(bit_table(frequent.select("lang", "word").mapInArrow(word_hashes, "h long")))

    def paths(pairs_told) -> DataFrame:
        told_of = lambda b: None if b is None else b.value
        made = texts.mapInArrow(lambda it: transducers(it, words_told.value, told_of(pairs_told), ranges, shard, most), SHARD_ROW)
        met = made.repartition("range", "lang").sortWithinPartitions("range", "lang")
        return met.mapInArrow(lambda it: united(it, least), PHRASE_ROW)

    pairs_told = spark.sparkContext.broadcast(bit_table(paths(None).select("h")))
    one = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("f"), F.array().cast("array<bigint>").alias("prefix"))
    every = written(one.unionByName(paths(pairs_told).drop("h")), "phrases")
    return every, words.where("word is null").select("lang", "n")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, most: int = MOST_WORDS, top: int = TOP, **more) -> DataFrame:
    """The ``top`` phrases of each language by the score of their weakest cut: (lang, rank, phrase, a, l,
    r, n, score, cut).

    a, l, r: occurrences of the phrase and of its parts at the cut, n: of all words; score:
    floor(1000 * a * n / (l * r)), in decimals of 38 digits. A phrase that occurs only within a longer
    candidate is left out. Null languages are ``und``, null texts empty; repeated rows count as often as
    they occur; an empty table has no rows. Other columns are ignored. Ties: the smallest cut; a, then
    the phrase's bytes.
    """
    every, totals = phrase_counts(docs, lang_col, text_col, least, most, **more)
    candidates = every.where("words >= 2").withColumn("w", F.split("phrase", " "))
    rests = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(F.array_join(F.slice("w", k + 1, F.col("words")), " ").alias("part"), k.alias("k")))
    parts = candidates.select("lang", "phrase", F.explode(F.concat(rests, F.array(F.struct(F.col("w")[0].alias("part"), F.lit(0).alias("k"))))).alias("p"))
    # composition: the parts' words with those of the united automata
    weights = every.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of"))
    composed = parts.select("lang", "phrase", "p.part", "p.k").join(weights, ["lang", "part"])
    longer = candidates.where("words >= 3").select("lang", F.explode(F.array(*[F.array_join(F.slice("w", s, F.col("words") - 1), " ") for s in (1, 2)])).alias("phrase"), F.col("f").alias("cover"))
    rows = composed.select("lang", "phrase", "k", "of").unionByName(longer, True).unionByName(candidates.select("lang", "phrase", "f", "prefix"), True)
    per = rows.groupBy("lang", "phrase").agg(
        F.max("f").alias("a"),
        F.any_value("prefix", True).alias("prefix"),
        F.max("cover").alias("cover"),
        F.max(F.when(F.col("k") == 0, F.col("of"))).alias("head"),
        F.collect_list(F.when(F.col("k") > 0, F.struct("k", F.col("of").alias("r")))).alias("rests"),
    )
    per = per.where("cover is null or cover < a").join(totals, "lang")

    def scored(x: Column) -> Column:
        left = F.when(x["k"] == 1, F.col("head")).otherwise(F.get("prefix", x["k"] - 2))
        return F.struct(score(F.col("a"), F.col("n"), left, x["r"]).alias("score"), x["k"].alias("cut"), left.alias("l"), x["r"].alias("r"))

    per = per.withColumn("best", F.array_min(F.transform("rests", scored))).select("lang", "phrase", "a", "n", "best.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    few = per.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    out = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("cut").cast("long").alias("cut"))


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (l * r)) in whole numbers of up to 38 digits."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", whole(a) * F.lit(1000).cast("decimal(4,0)") * whole(n), whole(left) * whole(right))


def oracle(least: int = LEAST, most: int = MOST_WORDS, top: int = TOP) -> str:
    """The same of table documents as DuckDB SQL."""
    return f"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, {most + 1}) AS r(k))),
f AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {least}),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT lang, phrase, f AS a, k, c, array_to_string(string_split(phrase, ' ')[:c], ' ') AS head, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS rest
  FROM f, range(1, {most}) AS r(c) WHERE c < k),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score, c.c AS cut
  FROM cuts AS c JOIN f AS x ON x.lang = c.lang AND x.phrase = c.head JOIN f AS y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals AS t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT DISTINCT x.lang, array_to_string(string_split(x.phrase, ' ')[i:i + m - 1], ' ') AS phrase, x.f
  FROM f AS x, range(2, {most}) AS r(m), range(1, {most}) AS q(i) WHERE m < x.k AND i + m - 1 <= x.k),
kept AS (SELECT b.* FROM best AS b WHERE NOT EXISTS (SELECT 1 FROM inner_ AS i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score, CAST(cut AS BIGINT) AS cut
FROM kept QUALIFY rank <= {top}
"""
