"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken target/size times on average. The whole part is certain;
the fractional parts are rounded dependently: two documents exchange words at random until one of
them is taken a whole number of times, which keeps the sum of words of the pair exactly and each
document's expectation. The one fractional document that a cell of documents leaves goes up a
reduction tree, where the cells' residuals are paired in the same way, until one remains a source.
Long documents are settled first, against as many shorter ones as they need, so that a short one remains:
a source's words miss its target by less than that.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ._store import written

#: Fixed values of the contract: weights by the sources' order, share of all words, most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Documents a cell holds on average, and residuals that one group of the reduction tree combines.
CELL = 4096
FAN = 256

#: Fractions within this of a whole number are one: sums of words in doubles are no better.
TINY = 1e-9

ROW = "id {id}, h long, size long, source string, source_size long, target double, p double, cell long, copies long, open boolean"


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``n``, its rows' numbers from 1 by ``column`` (a unique key; null last). Ranges of
    the column are numbered side by side; only the ranges' sizes reach the driver."""
    parts = written(df.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    upto, before = 0, []
    for part, n in sorted(tuple(r) for r in parts.groupBy("part").count().collect()):
        before += [F.lit(part), F.lit(upto)]
        upto += n
    local = F.row_number().over(Window.partitionBy("part").orderBy(F.col(column).asc_nulls_last()))
    first = F.element_at(F.create_map(*before), F.col("part")) if before else F.lit(0)
    return parts.withColumn("n", local + first).drop("part")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, docs, source_size) with one row a source -> the same and target.

    Targets share ``share`` of all words by weight and stop at ``most`` times a source's words; what
    exceeds that is reshared by weight among the others until no target is above: a few rounds, of
    which two sums each reach the driver. There may be as many sources as hosts.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    s = numbered(sizes, "source").withColumn("w", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = written(s.drop("n"), "sources")
    total = float((s.agg(F.sum("source_size")).first()[0] or 0) * share)
    level, known = 0.0, None  # words per weight; full are those whose cap lies at or below it
    while True:
        full = F.col("cap") <= F.col("w") * F.lit(level)
        now = s.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w"))), F.count_if(full)).first()
        if not now[1] or now[2] == known:  # all are full, or no more than before
            break
        level, known = max(level, (total - now[0]) / now[1]), now[2]
    return s.select("source", "docs", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(level)).alias("target"))


M64 = (1 << 64) - 1


def chance(a: int, b: int, seed: int) -> float:
    """A uniform number that depends on two documents' hashes only."""
    x = (a ^ (b * 0x9E3779B97F4A7C15) ^ (seed * 0xD1B54A32D192ED03)) & M64
    for _ in range(4):  # multiply and xor-shift
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & M64
    return ((x ^ (x >> 32)) >> 11) / (1 << 53)


def pivot(frame: pd.DataFrame, seed: int) -> pd.DataFrame:
    """One cell: rounds all fractions but one at most, the longest documents first.

    A document is paired with the next shorter ones, one after the other, and its mass moves in one random
    direction until it is integral: up with probability p, so that it takes (1 - p) w words of each partner,
    or down, so that it gives p w words to each, where w is the most that keeps the partner's own fraction
    within 0 and 1 either way. So each expectation stays, the words of all stay, and a document that is long
    for its cell is settled against as many short ones as it needs; what is left over is short."""
    frame = frame.sort_values(["size", "h"], ascending=[False, True], kind="stable").reset_index(drop=True)
    p, size, h = frame.p.tolist(), frame["size"].tolist(), frame.h.tolist()
    n = len(p)
    for j in range(n):
        if size[j] == 0 and 0.0 < p[j] < 1.0:  # carries no words: rounded on its own
            p[j] = float(chance(h[j], 1, seed) < p[j])
    whole = lambda x: 0.0 if x < TINY else 1.0 if x > 1 - TINY else x
    p = [whole(x) for x in p]
    after = list(range(1, n + 1))  # the next document that may be open, with paths shortened on the way

    def next_open(j: int) -> int:
        k = j
        while k < n and not 0.0 < p[k] < 1.0:
            k = after[k]
        while j < k:
            after[j], j = k, after[j]
        return k

    i, step = next_open(0), 0
    while i < n:
        need, moved, j = float(size[i]), [], next_open(i + 1)
        while need > 0 and j < n:
            most = min(p[j] * size[j] / (1 - p[i]), (1 - p[j]) * size[j] / p[i])
            w = min(most, need)
            moved.append((j, w))
            need -= w
            j = next_open(j + 1)
        if not moved:
            break
        # where all that is left is too short for it, it moves a part of the way and pairs again
        share = 1.0 if need <= TINY * size[i] else 1 - need / size[i]
        step += 1
        up = chance(h[i], h[moved[0][0]] + step, seed) < p[i]
        for k, w in moved:
            p[k] = whole(p[k] + (-(1 - p[i]) if up else p[i]) * w / size[k])
        p[i] = whole(p[i] + (1 - p[i]) * share if up else p[i] * (1 - share))
        i = next_open(i)
    frame["open"] = [0.0 < x < 1.0 for x in p]
    frame["p"] = p
    frame["copies"] = frame["copies"] + [int(x >= 1.0) for x in p]
    return frame


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, cell: int = CELL, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: (id, h, size, source_size, target, copies).

    size: words of the whole text; h: a hash of id and text. A null text has no words; null is a source
    of its own, the last. Documents without words are taken as often as their source on average. A
    table without words has targets 0. Repeated rows are documents of their own. The numbers depend on
    the rows alone, not on their order or partitions. Other columns are ignored.

    Texts are read once, for a small table of sizes. A source is dealt into as many cells as it has
    documents for, so a hot source fills many groups; only one row a cell goes up the tree.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    small = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("h"), n_words(F.col(text_col)).alias("size"), F.col(source_col).cast("string").alias("source"))
    small = written(small, "sizes")
    per = targets(small.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")))
    per = per.select(F.col("source").alias("s"), "docs", "source_size", "target")
    mean = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    rows = small.join(per, small.source.eqNullSafe(per.s)).drop("s")
    rows = rows.withColumn("copies", F.floor(mean).cast("long")).withColumn("p", mean - F.floor(mean)).withColumn("cell", F.pmod("h", F.ceil(F.col("docs") / cell)).cast("long")).withColumn("open", F.lit(True))
    schema = ROW.format(id=kind)
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def level(df: DataFrame) -> DataFrame:
        return written(df.select(columns).groupBy("source", "cell").applyInPandas(lambda f: pivot(f, seed)[columns], schema), "cells")

    done = []
    while True:
        step = level(rows)
        done.append(step.where("not open"))
        rows = step.where("open")
        top = rows.agg(F.max("cell")).first()[0]
        if not top:  # one cell a source is left
            break
        rows = rows.withColumn("cell", F.floor(F.col("cell") / fan).cast("long"))
    last = F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < F.col("p")
    done.append(rows.withColumn("copies", F.col("copies") + last.cast("long")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("id").alias(id_col), "h", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``copies`` says; all columns stay, whatever
    their names."""
    # a row travels as one struct, so that no name of its columns can clash with those used here
    nth = F.row_number().over(Window.partitionBy("id", "h").orderBy("h"))  # repeated rows keep their own counts
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("h")).withColumn("n", nth)
    taken = copies(docs, id_col, text_col, source_col, seed).where("copies > 0").withColumnRenamed(id_col, "id")
    taken = taken.select(F.col("id").alias("of"), F.col("h").alias("k"), "copies", F.row_number().over(Window.partitionBy("id", "h").orderBy(F.desc("copies"))).alias("m"))
    both = rows.join(taken, F.col("id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("k")) & (F.col("n") == F.col("m")))
    return both.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
