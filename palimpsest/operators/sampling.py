"""Deterministic sampling: every choice is an order by a hash, so partitions and reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(column: str, seed: int = 0) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string")))


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows (TakeOrderedAndProject: no full sort)."""
    return rows.orderBy(shuffle_key(key, seed), key).limit(n)


def first_per(rows: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark prunes within partitions before the shuffle."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def ranked(rows: DataFrame, stratum: str, key: str, seed: int = 0, name: str = "_r") -> DataFrame:
    """``rows`` with their number, from 1, in the order by hash within their stratum. The hash deals a stratum
    into 4,096 ranges that are numbered side by side; what lies before a range comes from the ranges' sizes, so
    that a few strata of any size make many tasks."""
    h = shuffle_key(key, seed)
    dealt = rows.withColumn("_b", F.substring(h, 1, 3))
    sizes = dealt.groupBy(F.col(stratum).alias("_s"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_s", "_c", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(stratum, "_b").orderBy(h, key))
    out = dealt.withColumn(name, nth).join(before, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c")))
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_b", "_c", "_s", "_before")


def round_robin(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows taken from the strata in turn. No stratum gives more than n, so each is cut to n first."""
    return ranked(rows, stratum, key, seed).where(F.col("_r") <= n).orderBy("_r", stratum).limit(n).drop("_r")


def each_and_more(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by hash order, but at least one of each stratum (as far as n goes)."""
    h = shuffle_key(key, seed)
    first = rows.groupBy(F.col(stratum).alias("_s")).agg(F.min(F.struct(h.alias("h"), F.col(key).alias("k")))["k"].alias("_k"))
    led = rows.join(first, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col(key) == F.col("_k")), "left")
    return led.orderBy(F.col("_k").isNull(), h, key).limit(n).drop("_s", "_k")


def split(rows: DataFrame, key: str, stratum: str, assigned: DataFrame, share: float = 0.4, seed: int = 0) -> DataFrame:
    """(key, stratum, split): held_out for round(share * size) of each stratum less those assigned
    already; earlier assignments (key, split) stay."""
    a = assigned.select(F.col(key), F.col("split").alias("before"))
    all_rows = rows.join(a, key, "left")
    per = all_rows.groupBy(F.col(stratum).alias("_of")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("before") == "held_out", 1).otherwise(0)).alias("done"))
    new = ranked(all_rows.where("before is null"), stratum, key, seed).join(per, F.col(stratum).eqNullSafe(F.col("_of")))
    quota = F.greatest(F.lit(0), F.round(F.col("n") * share).cast("long") - F.col("done"))
    new = new.withColumn("split", F.when(F.col("_r") <= quota, "held_out").otherwise("dev"))
    return new.select(key, stratum, "split").unionByName(all_rows.where("before is not null").select(key, stratum, F.col("before").alias("split")))
