"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

SuperMinHash gives each element of a set one random permutation of the signature's slots: the
element's rank for slot ``p[j]`` is ``j`` plus a random fraction, so its ranks over the slots are
correlated, and the agreement of two signatures varies less than with independent hashes. Slots keep
the smallest rank; once every slot holds less than ``j`` no element can lower one at step ``j``
(early stopping: long texts need one or two steps).

Links are pairs of documents whose distinct shingle sets meet ``percent`` of their union. Candidates
share one band of the signature; with 25 bands of 5 rows a pair at 0.85 is missed with probability
(1 - 0.85**5)**25 = 4e-7, a pair at 0.9 with 5e-10. Every candidate is confirmed on full sets.
Equal sets form a class that one document stands for, so copies never make pairs among each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._graph import components
from ._store import written
from ._words import BASE, U, mix, shingle_sets

BANDS, ROWS = 25, 5
FRACTION = U(48)


def signatures(element: np.ndarray, at: np.ndarray, slots: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash signatures of many sets: ``element`` holds distinct hashes set by set, ``at`` the
    index of each set's first. Row i of the result is the signature of set i (all ones if empty)."""
    n = len(at) - 1
    sig = np.full((n, slots), np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(at))
    x = mix(element ^ BASE)
    flat = sig.reshape(-1)
    perm = None
    for j in range(slots):
        if not len(x):
            break
        r = mix(x + U((2 * j + 1) * int(BASE) % (1 << 64)))
        k = (j + (((r & U(0xFFFFFFFF)) * U(slots - j)) >> U(32)).astype(np.int64)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(x))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
        np.minimum.at(flat, owner * slots + slot, (U(j) << FRACTION) | (mix(r) >> U(16)))
        busy = (sig.max(axis=1) >> FRACTION) > U(j)  # a rank of the next step could still be smaller
        keep = busy[owner]
        if not keep.any():
            break
        if perm is None:
            owner, x, k0 = owner[keep], x[keep], k[keep]
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(x), 1))
            perm[np.arange(len(x)), k0] = 0
        elif keep.mean() < 0.7:
            owner, x, perm = owner[keep], x[keep], perm[keep]
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64) * BASE
        for r in range(rows):
            h = mix(h ^ sig[:, b * rows + r]) + BASE
        out[:, b] = h
    return out.view(np.int64)


def fingerprints(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, h, at in shingle_sets(batch.column(1), width):
            n = np.diff(at)
            total = np.concatenate([[U(0)], np.cumsum(mix(h + BASE))])
            other = np.concatenate([[U(0)], np.cumsum(mix(h ^ U(2 * int(BASE) % (1 << 64))))])
            keys = band_keys(signatures(h, at, bands * rows), bands, rows)
            lists = pa.ListArray.from_arrays(np.arange(0, len(n) * bands + 1, bands, dtype=np.int32), keys.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)), pa.array((other[at[1:]] - other[at[:-1]]).view(np.int64)), lists],
                names=["id", "n", "set_a", "set_b", "bands"],
            )


def full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, h, at in shingle_sets(batch.column(1), width):
            data = h.tobytes()
            blobs = [data[8 * s : 8 * e] for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(blobs, pa.binary())], names=["id", "elements"])


def confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        keep = np.zeros(len(batch), bool)
        last, x = None, None
        for i in range(len(batch)):
            raw = left[i].as_buffer()
            if last is None or raw != last:
                last, x = raw, np.frombuffer(raw, np.uint64)
            y = np.frombuffer(right[i].as_buffer(), np.uint64)
            short, long = (x, y) if len(x) < len(y) else (y, x)
            place = np.searchsorted(long, short)
            place[place == len(long)] = 0
            both = int((long[place] == short).sum()) if len(long) else 0
            keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, component_id, kept).

    component_id is the smallest id that links reach. Null and empty texts, and those of white space
    only, have no shingles and link with nothing; a text of fewer than ``width`` words has one shingle.
    Rows that repeat an id give a row each, with its own n_shingles; they are one document, linked with
    whatever any of its texts is linked with. Rows with a null id are kept with component null. Other
    columns are ignored. Sets count as equal if their sizes and two 64-bit sums of hashes are.

    Plan: one pass over the texts makes fixed-size fingerprints (written, since they are read several
    times). Equal sets collapse by a pre-aggregated grouping. A bucket's documents are compared with its
    leader, the smallest id, never all with all. Where different components still meet in a bucket, the
    documents outside its largest component are compared with the others in blocks that emit links
    only, so that no link is lost. One shuffle brings the texts of documents in shared buckets to be
    shingled again for the checks on full sets.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = written(texts.mapInArrow(lambda it: fingerprints(it, width, bands, rows), "id long, n long, set_a long, set_b long, bands array<long>"), "fingerprints")

    sets = prints.where("n > 0 and id is not null")
    # bands are a function of the set, so any member's serve the class
    classes = written(sets.groupBy("set_a", "set_b", "n").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "classes")
    members = classes.select("id", "n", F.explode("bands").alias("bucket"))
    # one leader a bucket; a pair that differs too much in size can't be linked
    lead = members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("l"), F.count("*").alias("c")).where("c > 1").select("bucket", F.col("l.id").alias("leader"), F.col("l.n").alias("m"))
    members = written(members.join(lead, "bucket"), "members")
    wanted = members.select("id").distinct()
    full = texts.hint("merge").join(wanted, "id", "left_semi").mapInArrow(lambda it: full_sets(it, width), "id long, elements binary")
    full = written(full, "sets")

    close = F.expr(f"100 * least(n, m) >= {int(percent)} * greatest(n, m)")
    pairs = members.where((F.col("id") != F.col("leader")) & close).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    both = pairs.join(full.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a").join(full.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b").select("a", "b", "x", "y")
    edges = written(both.mapInArrow(lambda it: confirmed(it, percent), "a long, b long"), "links")
    label = written(components(edges), "labels")

    more = _rest(members, classes, full, label, percent)
    edges = written(edges.unionByName(more), "links")
    label = written(components(edges), "labels")

    class_of = classes.select("set_a", "set_b", "n", F.col("id").alias("rep"))
    out = prints.select("id", "n", "set_a", "set_b").join(class_of, ["set_a", "set_b", "n"], "left")
    out = out.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left")
    comp = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), (F.col("id") == comp).alias("kept"))


def _rest(members: DataFrame, classes: DataFrame, full: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Links between components that meet in a bucket. What the leaders left apart is compared in
    full, in blocks: documents outside the bucket's largest component with all others of the bucket."""
    lab = label.select(F.col("id").alias("of"), "component")
    held = members.select("bucket", "id", "n").join(lab, F.col("id") == F.col("of"), "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    per = held.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.sum("n").alias("e")).groupBy("bucket").agg(F.max(F.struct("c", "component", "e")).alias("top"), F.sum("c").alias("c"), F.sum("e").alias("e"), F.count("*").alias("k")).where("k > 1 and c > 2")  # of two, one is the leader
    blocks = lambda n, e: F.ceil(F.greatest(n / F.lit(BLOCK), e / F.lit(ELEMENTS))).cast("int")
    per = per.select("bucket", F.col("top.component").alias("main"), blocks(F.col("c") - F.col("top.c"), F.col("e") - F.col("top.e")).alias("apart"), blocks(F.col("top.c"), F.col("top.e")).alias("inside"))
    held = held.join(per, "bucket")
    out = F.col("component") != F.col("main")
    own = F.pmod(F.xxhash64("id"), F.when(out, F.col("apart")).otherwise(F.col("inside"))).cast("int")
    # groups (i, j): block i of the documents apart with its own kind (j < apart) or with the main component's
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    up = lambda n: F.sequence(F.lit(0), n - 1)
    among = F.transform(up(F.col("apart")), lambda k: cell(F.least(k, F.col("own")), F.greatest(k, F.col("own")), F.when(k < F.col("own"), 1).otherwise(0)))
    across = F.transform(up(F.col("inside")), lambda k: cell(F.col("own"), F.col("apart") + k, 0))
    as_main = F.transform(up(F.col("apart")), lambda k: cell(k, F.col("apart") + F.col("own"), 1))
    held = held.withColumn("out", out).withColumn("own", own)
    held = held.select("bucket", "id", "n", "component", F.explode(F.when(F.col("out"), F.concat(among, across)).otherwise(as_main)).alias("g"))
    held = held.select("bucket", F.col("g.i").alias("i"), F.col("g.j").alias("j"), F.col("g.side").alias("side"), "id", "n", "component")
    held = held.join(full, "id").join(classes.select("id", "bands"), "id")
    return held.groupBy("bucket", "i", "j").applyInPandas(lambda key, f: linked(key, f, percent), "a long, b long")


#: Documents and their shingles in a block of a large bucket, on average.
BLOCK, ELEMENTS = 512, 400_000


def prefixes(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """The first elements of each ascending set: two sets that meet ``percent`` of their union share one."""
    return [x[: len(x) - -(-percent * len(x) // 100) + 1] for x in sets]


def linked(key: tuple, frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A forest of the links between different components of two blocks of a bucket. A pair that
    shares an earlier band is left to that band's bucket. Pairs come from a prefix filter, never from
    all of them, and are confirmed on full sets."""
    left, right = frame[frame.side == 0], frame[frame.side == 1]
    if key[1] == key[2]:
        right = left
    a, b = [], []
    if len(left) and len(right):
        ids, n = right.id.to_numpy(), right.n.to_numpy()
        # components by number, and what each has become
        _, number = np.unique(np.concatenate([left.component.to_numpy(), right.component.to_numpy()]), return_inverse=True)
        mine, comp = number[: len(left)].copy(), number[len(left) :].copy()
        bands = np.stack(right.bands.to_list())
        sets = [np.frombuffer(e, np.uint64) for e in right.elements]
        first = prefixes(sets, percent)
        owner = np.repeat(np.arange(len(first)), [len(x) for x in first])
        first = np.concatenate(first)
        order = np.argsort(first, kind="stable")
        first, owner = first[order], owner[order]
        own_sets = [np.frombuffer(e, np.uint64) for e in left.elements]
        for i, (of, k, own, x, head) in enumerate(zip(left.id.tolist(), left.n.tolist(), left.bands, own_sets, prefixes(own_sets, percent), strict=True)):
            lo, hi = np.searchsorted(first, head), np.searchsorted(first, head, side="right")
            lo, hi = lo[hi > lo], hi[hi > lo]
            if not len(lo):
                continue
            todo = np.unique(np.concatenate([owner[s:e] for s, e in zip(lo.tolist(), hi.tolist(), strict=True)]))
            own = np.asarray(own)
            place = int(np.flatnonzero(own == key[0])[0])
            todo = todo[(comp[todo] != mine[i]) & (100 * np.minimum(n[todo], k) >= percent * np.maximum(n[todo], k))]
            todo = todo[~(bands[todo, :place] == own[:place]).any(axis=1)]
            for r in todo.tolist():
                if comp[r] == mine[i]:
                    continue
                y = sets[r]
                short, long = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(long, short)
                at[at == len(long)] = 0
                both = int((long[at] == short).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    old, new = comp[r], mine[i]
                    comp[comp == old] = new
                    mine[mine == old] = new
                    a.append(of)
                    b.append(int(ids[r]))
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that stand for their component. Documents without words and rows with a null
    id all stay; of rows that repeat an id, all stay if one does."""
    gone = near_duplicates(docs, id_col, text_col, percent).groupBy(F.col(id_col).alias("id")).agg(F.max("kept").alias("kept")).where("not kept").select("id")
    # a row travels as one struct, so that no name of its columns can clash
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    return rows.join(gone, "id", "left_anti").select("row.*")
