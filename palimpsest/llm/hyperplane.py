"""Near-duplicate vectors by random-hyperplane sign hashing, exact cosine and connected components.

Each of several tables hashes a vector to the signs of its products with random hyperplanes. Two
vectors at angle t agree on one sign with probability 1 - t/pi, so with 10 bits and 14 tables a pair at
cosine 0.98 is missed with probability (1 - 0.936**10)**14 = 4e-5 and a pair at 0.99 with 3e-7. The
more vectors a label has, the more bits its signs have, so that its buckets stay as large as they are;
and the more bits, the more tables, so that no more pairs are missed. Vectors of one bucket (table,
label, signs) are compared in blocks by one matrix product; a pair that meets in several tables counts
in the first of them only. Equal vectors form a class that is compared once and weighs its number of
copies.
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

BITS, MOST_BITS, BLOCK = 10, 24, 256
#: Vectors of a label for each combination of its signs; a label of more gets one more bit.
PER_SIGN = 64
#: Greatest probability that a pair at the threshold meets in no table.
MISSED = 5e-5
#: Vectors of small buckets that share a group, about.
GROUP = 1024


def tables_for(bits: int, threshold: float, missed: float = MISSED) -> int:
    """How many tables of ``bits`` signs leave a pair at the threshold unmet with at most ``missed``."""
    agree = (1 - np.arccos(threshold) / np.pi) ** bits
    return max(1, int(np.ceil(np.log(missed) / np.log1p(-agree))))


def planes(dim: int, bits: int, tables: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dim, bits]).standard_normal((dim, tables * bits))


def signs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(id, label, vec, copies, bits) -> the same with one integer of signs per table, by bits."""
    for batch in batches:
        vectors = [np.frombuffer(v, np.float64) for v in batch.column(2).to_pylist()]
        bits = batch.column(4).to_numpy(zero_copy_only=False)
        out: list = [None] * len(vectors)
        kinds = np.array([(len(v), b) for v, b in zip(vectors, bits, strict=True)]).reshape(-1, 2)
        for d, b in np.unique(kinds, axis=0).tolist():
            rows = np.flatnonzero((kinds == (d, b)).all(axis=1))
            tables = tables_for(b, threshold)
            x = np.stack([vectors[i] for i in rows])
            s = (x / np.abs(x).max(axis=1, keepdims=True)) @ planes(d, b, tables) >= 0
            found = s.reshape(len(rows), tables, b) @ (1 << np.arange(b, dtype=np.int64))
            for i, one in zip(rows.tolist(), found.astype(np.int32), strict=True):
                out[i] = one
        at = np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(at, np.concatenate([np.zeros(0, np.int32), *out]))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "label", "vec", "copies", "bits", "signs"])


def unit(vectors: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """id -> smallest id of its tree, for the vertices of the pairs."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent.setdefault(x, x)
        parent.setdefault(y, y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def compare(key: tuple, frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links within the buckets of a group, each a pair of blocks: every linked vector's number of linked
    copies, and a spanning forest. A pair that shares an earlier table's signs is left to that table."""
    table, i, j = int(key[0]), int(key[2]), int(key[3])
    frame = frame.sort_values(["label", "dim", "sign"], kind="stable")
    side, ids, copies = frame.side.to_numpy(), frame.id.to_numpy(), frame.copies.to_numpy()
    label, dim, sign = (frame[c].to_numpy() for c in ("label", "dim", "sign"))
    earlier = np.stack([s[:table] for s in frame.signs])
    vectors = frame.vec.to_list()
    edge = np.flatnonzero((label[1:] != label[:-1]) | (dim[1:] != dim[:-1]) | (sign[1:] != sign[:-1])) + 1
    a_all, b_all, links = [], [], np.zeros(len(frame), np.int64)
    for s, e in zip(np.append(0, edge), np.append(edge, len(frame)), strict=True):
        if e - s < 2:
            continue
        rows = np.arange(s, e)
        x = unit(vectors[s:e])
        left = np.flatnonzero(side[s:e] == 0)
        right = left if i == j else np.flatnonzero(side[s:e] == 1)
        if not len(left) or not len(right):
            continue
        hit = x[left] @ x[right].T >= threshold
        p, q = np.nonzero(np.triu(hit, 1) if i == j else hit)
        p, q = rows[left[p]], rows[right[q]]
        if table:
            fresh = ~(earlier[p] == earlier[q]).any(axis=1)
            p, q = p[fresh], q[fresh]
        np.add.at(links, p, copies[q])
        np.add.at(links, q, copies[p])
        a_all.append(ids[p])
        b_all.append(ids[q])
    root = forest(zip(np.concatenate(a_all).tolist(), np.concatenate(b_all).tolist(), strict=True)) if a_all else {}
    linked = np.flatnonzero(links > 0)
    return pd.DataFrame({"id": ids[linked], "links": links[linked], "root": np.array([root[x] for x in ids[linked].tolist()], np.int64)})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, bits: int = BITS, per_sign: int = PER_SIGN, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: (id, n_links, component_id, kept).

    Only vectors with equal, non-null labels and equal lengths are compared, by cosine in double
    precision. A vector that is null, empty, zero, or holds a null, NaN or infinite component links
    with nothing, and neither does a row with a null id. Rows that repeat an id are rows of their own
    for the links, and one vertex for the component. Other columns are ignored.

    A label of n different vectors has the least number of bits, from ``bits`` to MOST_BITS, whose
    combinations leave ``per_sign`` vectors each on average.

    Hot buckets: a bucket is dealt into blocks of ``block`` vectors by hash and each pair of blocks is
    a group of its own, so no task holds more than two blocks; counts and a forest leave it, not pairs.
    """
    ship(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    v = v.withColumn("v", F.when(good & F.col("label").isNotNull() & F.col("id").isNotNull(), F.transform("v", lambda x: x + F.lit(0.0))))
    classes = v.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = written(classes, "vectors")
    need = F.ceil(F.log2(F.col("of_label") / per_sign)).cast("int")
    sizes = classes.groupBy("label").agg(F.count("*").alias("of_label")).select("label", F.least(F.greatest(need, F.lit(bits)), F.lit(MOST_BITS)).alias("bits"))
    raw = classes.join(sizes, "label").select("id", "label", F.col("v"), "copies", "bits").mapInArrow(_packed, "id long, label string, vec binary, copies long, bits int")
    hashed = written(raw.mapInArrow(lambda it: signs(it, threshold), "id long, label string, vec binary, copies long, bits int, signs array<int>"), "signs").drop("bits")
    dealt = hashed.select("*", F.posexplode("signs").alias("table", "sign")).withColumn("dim", F.length("vec"))
    key = ["table", "label", "dim", "sign"]
    size = dealt.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = dealt.join(size, key).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block i meets block j >= i: a row goes to group (own, j) as left and to (i, own) as right
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), F.when(k < F.col("own"), 1).otherwise(0).alias("side")))
    # many small buckets share a group; a bucket of several blocks has its own
    few = max(1, hashed.count() // GROUP)
    mixed = F.xxhash64("label", "dim", "sign")
    part = F.when(F.col("blocks") == 1, F.pmod(mixed, F.lit(few))).otherwise(mixed)
    rest = ["label", "dim", "sign", "id", "copies", "vec", "signs"]
    dealt = dealt.select("table", part.alias("part"), *rest, F.explode(meets).alias("m")).select("table", "part", F.col("m.i").alias("i"), F.col("m.j").alias("j"), F.col("m.side").alias("side"), *rest)
    found = written(dealt.groupBy("table", "part", "i", "j").applyInPandas(lambda k, f: compare(k, f, threshold), "id long, links long, root long"), "links")
    label = written(components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))), "labels")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    per = classes.join(counts, "id", "left").join(label, "id", "left").select("label", "v", F.col("id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    out = v.join(per, ["label", "v"], "left")
    comp = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("id") == comp).alias("kept"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        flat, at = np.asarray(lists.flatten(), np.float64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        blobs = pa.array([flat[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blobs, batch.column(3), batch.column(4)], names=["id", "label", "vec", "copies", "bits"])
