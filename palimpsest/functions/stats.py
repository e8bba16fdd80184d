"""Statistics as Column expressions, and the bootstrap as a grouped function."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

Z = 1.96


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Score interval (low, high) of a share, clamped to 0..1; (0, 0) for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = successes / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    none = n.isNull()  # greatest and least skip nulls
    return F.when(none, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), middle - margin)), F.when(none, F.lit(0.0)).otherwise(F.least(F.lit(1.0), middle + margin))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts: twice the lower binomial tail, at most 1.

    Up to 1,000 pairs the terms are summed as they are. Beyond, where 0.5 ** n leaves the doubles, the
    largest term of the tail is taken in logarithms (Stirling's series of the factorials from 10 on),
    the smaller ones relative to it, downwards until they no longer count: 60 standard deviations of the
    count at most, and in no case more than ``b`` or ``c`` terms."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")

    def log_factorial(x: Column) -> Column:
        exact = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(10)])
        x1 = F.greatest(x, F.lit(10.0))
        series = (x1 + 0.5) * F.log(x1) - x1 + 0.5 * math.log(2 * math.pi) + 1 / (12 * x1) - 1 / (360 * x1 * x1 * x1) + 1 / (1260 * F.pow(x1, F.lit(5.0)))
        return F.when(x < 10, F.get(exact, F.least(x, F.lit(9.0)).cast("int"))).otherwise(series)

    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + n * math.log(0.5)
    # term i - 1 by term i is i / (n - i + 1); below the middle the terms fall at least like a Gaussian's
    many = F.least(k, F.ceil(60 * F.sqrt(n / 4) + 60)).cast("long")
    steps = F.when(many > 0, F.sequence(F.lit(1).cast("long"), F.greatest(many, F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>"))

    def add(acc: Column, j: Column) -> Column:
        i = k - j + 1
        t = acc["t"] * i / (n - i + 1)
        return F.struct(t.alias("t"), (acc["sum"] + t).alias("sum"))

    def rise(acc: Column, i: Column) -> Column:
        t = acc["t"] * (n - i + 1) / i
        return F.struct(t.alias("t"), (acc["sum"] + t).alias("sum"))

    tail = F.aggregate(steps, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("sum")), add, lambda acc: acc["sum"])
    short = (n <= 1000) & (k > 0)
    counts = F.when(short, F.sequence(F.lit(1).cast("long"), F.when(short, k.cast("long")).otherwise(F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    least = F.pow(F.lit(0.5), n)
    few = F.aggregate(counts, F.struct(least.alias("t"), least.alias("sum")), rise, lambda acc: acc["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.when(n <= 1000, few).otherwise(F.exp(top + F.log(tail)))))


def rate(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


def bootstrap(values: DataFrame, group: str, value: str, resamples: int = 2000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(group, value, ci_low, ci_high, n): percentile bootstrap of each group's mean, nulls skipped.

    The generator is the seeded Mersenne Twister of Python, over values in ascending order, so that
    results don't depend on partitions. A group must fit in one task: metrics have a row per query.
    For groups without bound use ``poisson_bootstrap``.
    """

    ship(values.sparkSession)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        x = sorted(frame[value].dropna().tolist())
        n = len(x)
        name = frame[group].iloc[0]
        if not n:
            return pd.DataFrame({group: [name], "value": [0.0], "ci_low": [0.0], "ci_high": [0.0], "n": [0]})
        rng = random.Random(seed)
        means = sorted(sum(x[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))
        low, high = means[int(alpha / 2 * resamples)], means[min(resamples - 1, int((1 - alpha / 2) * resamples))]
        return pd.DataFrame({group: [name], "value": [sum(x) / n], "ci_low": [low], "ci_high": [high], "n": [n]})

    kind = values.schema[group].dataType.simpleString()
    return values.select(group, value).groupBy(group).applyInPandas(one, f"`{group}` {kind}, value double, ci_low double, ci_high double, n long")


def poisson_bootstrap(values: DataFrame, group: str, key: str, value: str, resamples: int = 200) -> DataFrame:
    """(group, resample, mean): each row weighs by a hash of its key and the resample, so that no
    group is ever collected and any engine can repeat it. Weights are 0 to 3 with mean 1."""
    draws = values.where(F.col(value).isNotNull()).select(group, key, value, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("resample").cast("string"))), 1, 6), 16, 10).cast("double") / float(1 << 24)
    weight = F.when(u < 0.3679, 0).when(u < 0.7358, 1).when(u < 0.9197, 2).otherwise(3)
    return draws.withColumn("w", weight).groupBy(group, "resample").agg((F.sum(F.col(value) * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))


def log_bin(v: Column, error: float) -> Column:
    """A bin of a value (0 for 0, negative numbers for negative values): bins of one sign grow by a constant
    factor, so that a bin's middle is off by the share ``error`` at most; the values from 1e-12 to 1e15 have
    some 31 / error bins, however many rows there are."""
    step = math.log((1 + error) / (1 - error))
    # places are moved by 2^30, so that their sign tells the value's
    place = F.ceil(F.log(F.abs(v)) / F.lit(step)).cast("long") + (1 << 30)
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, place).otherwise(-place)


def bin_value(b: Column, error: float) -> Column:
    """The value that stands for a bin."""
    g = (1 + error) / (1 - error)
    middle = F.pow(F.lit(g), (F.abs(b) - (1 << 30)).cast("double")) * (2 / (g + 1))
    return F.when(b == 0, 0.0).when(b > 0, middle).otherwise(-middle)


def quantile(p: float) -> Callable[[Column], Column]:
    """The smallest value at or below which a share ``p`` of the weight lies, of an ascending array of
    (v, w)."""

    def of(bins: Column) -> Column:
        need = F.aggregate(bins, F.lit(0.0), lambda acc, x: acc + x["w"]) * p

        def add(acc: Column, x: Column) -> Column:
            upto = acc["upto"] + x["w"]
            return F.struct(upto.alias("upto"), F.when(acc["v"].isNull() & (upto >= need) & (x["w"] > 0), x["v"]).otherwise(acc["v"]).alias("v"))

        start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("double").alias("v"))
        return F.aggregate(bins, start, add, lambda acc: acc["v"])

    return of


def average(bins: Column) -> Column:
    total = F.aggregate(bins, F.lit(0.0), lambda acc, x: acc + x["w"])
    return F.aggregate(bins, F.lit(0.0), lambda acc, x: acc + x["v"] * x["w"]) / F.nullif(total, F.lit(0.0))


def share_above(limit: float) -> Callable[[Column], Column]:
    def of(bins: Column) -> Column:
        total = F.aggregate(bins, F.lit(0.0), lambda acc, x: acc + x["w"])
        return F.aggregate(F.filter(bins, lambda x: x["v"] > limit), F.lit(0.0), lambda acc, x: acc + x["w"]) / F.nullif(total, F.lit(0.0))

    return of


def bootstrap_of(values: DataFrame, group: str, key: str, value: str, statistic: Callable[[Column], Column], resamples: int = 200, alpha: float = 0.05, error: float | None = 0.01) -> DataFrame:
    """(group, value, ci_low, ci_high, n): percentile bootstrap of any statistic of each group.

    ``statistic`` takes an ascending array of (v, w), values and their weights, to a number: ``quantile(p)``,
    ``average``, ``share_above(x)`` or one's own. In each resample a row weighs by a hash of its key
    (weights 0 to 3 of mean 1). Rows meet as weights of bins, added up before and after the shuffle, so no
    task ever holds a group: a bin's value is off by the share ``error`` at most. With ``error=None`` bins
    are the values themselves, for statistics of few distinct values. Null and NaN values are skipped; a group
    with none has value and interval null and n 0.
    """
    v = F.col(value).cast("double")
    some = v.isNotNull() & ~F.isnan(v)
    at = v if error is None else log_bin(v, error)
    draws = values.where(some).select(F.col(group).alias("g"), F.col(key).alias("k"), at.alias("b"), F.explode(F.sequence(F.lit(-1), F.lit(resamples - 1))).alias("resample"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("k").cast("string"), F.col("resample").cast("string"))), 1, 6), 16, 10).cast("double") / float(1 << 24)
    # resample -1 is the sample itself
    w = F.when(F.col("resample") < 0, 1).when(u < 0.3679, 0).when(u < 0.7358, 1).when(u < 0.9197, 2).otherwise(3)
    bins = draws.groupBy("g", "resample", "b").agg(F.sum(w).cast("double").alias("w"))
    one = F.struct((F.col("b") if error is None else bin_value(F.col("b"), error)).alias("v"), "w")
    each = bins.groupBy("g", "resample").agg(F.array_sort(F.collect_list(one)).alias("bins"))
    each = each.select("g", "resample", statistic(F.col("bins")).alias("s"), F.aggregate("bins", F.lit(0.0), lambda acc, x: acc + x["w"]).alias("total"))
    whole = F.col("resample") < 0
    out = each.groupBy("g").agg(F.max(F.when(whole, F.col("s"))).alias("value"), F.array_sort(F.collect_list(F.when(~whole, F.col("s")))).alias("s"), F.max(F.when(whole, F.col("total"))).cast("long").alias("n"))
    low = F.get("s", F.floor(F.size("s") * (alpha / 2)).cast("int"))
    high = F.get("s", F.least(F.size("s") - 1, F.floor(F.size("s") * (1 - alpha / 2)).cast("int")))
    out = out.select("g", "value", low.alias("ci_low"), high.alias("ci_high"), "n")
    every = values.select(F.col(group).alias("g0")).distinct()
    return every.join(out, F.col("g0").eqNullSafe(F.col("g")), "left").select(F.col("g0").alias(group), "value", "ci_low", "ci_high", F.coalesce("n", F.lit(0)).alias("n"))
