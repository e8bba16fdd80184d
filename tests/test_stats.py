import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import stats


def binomial_p(b, c):
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + n * math.log(0.5) for i in range(max(0, k - 3_000_000), k + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top + math.log(sum(math.exp(x - top) for x in logs))))


def test_mcnemar_of_any_count(spark):
    pairs = [(0, 0), (0, 1), (1, 0), (3, 9), (10, 10), (25, 40), (500, 620), (5_000, 5_300), (0, 2_000), (1_000_000, 1_002_000), (300_000_000, 300_050_000)]
    df = spark.createDataFrame(pairs, "b long, c long")
    for r in df.select("b", "c", stats.mcnemar(df.b, df.c).alias("p")).collect():
        want = binomial_p(r["b"], r["c"])
        assert r["p"] == pytest.approx(want, rel=2e-5, abs=1e-12), r


def test_bins_stand_for_their_values(spark):
    r = random.Random(1)
    values = [0.0, 1.0, -1.0, 1e-9, 1e12] + [r.choice([-1, 1]) * 10 ** r.uniform(-6, 9) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", stats.log_bin(df.v, 0.01).alias("b")).withColumn("m", stats.bin_value(F.col("b"), 0.01)).collect()
    assert all(abs(r["m"] - r["v"]) <= 0.01 * abs(r["v"]) * (1 + 1e-9) for r in got)
    ordered = sorted(got, key=lambda r: r["v"])
    assert all(a["m"] <= b["m"] for a, b in zip(ordered, ordered[1:], strict=False))


@pytest.mark.parametrize(("statistic", "of"), [
    (stats.quantile(0.95), lambda x: sorted(x)[math.ceil(0.95 * len(x)) - 1]),
    (stats.average, lambda x: sum(x) / len(x)),
    (stats.share_above(50.0), lambda x: sum(v > 50 for v in x) / len(x)),
])
def test_any_statistic(spark, statistic, of):
    r = random.Random(5)
    rows = [(i, "ab"[i % 2], float(r.randint(0, 100) if i % 2 else r.randint(40, 60))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(4)
    for error in (None, 0.01):
        got = {x["g"]: x for x in stats.bootstrap_of(df, "g", "id", "v", statistic, 60, error=error).collect()}
        for g in "ab":
            want = of([v for _, k, v in rows if k == g])
            assert got[g]["value"] == pytest.approx(want, rel=0.011 if error else 1e-9, abs=0.03 if error else 1e-9)
            assert got[g]["ci_low"] <= got[g]["value"] * 1.0001 and got[g]["value"] <= got[g]["ci_high"] * 1.0001 and got[g]["n"] == 1500
    assert sorted(map(tuple, stats.bootstrap_of(df.coalesce(1), "g", "id", "v", statistic, 20).collect())) == sorted(map(tuple, stats.bootstrap_of(df, "g", "id", "v", statistic, 20).collect()))


def test_interval_covers_the_truth(spark):
    df = spark.range(4000).selectExpr("id", "cast(id % 20 as string) as g", "cast(pmod(xxhash64(id), 100000) as double) as v")
    got = stats.bootstrap_of(df, "g", "id", "v", stats.quantile(0.5), 100).collect()
    assert sum(r["ci_low"] <= 50_000 <= r["ci_high"] for r in got) >= 16


def test_odd_groups(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, "n", None), (3, "nan", float("nan")), (4, "neg", -3.0)], "id int, g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in stats.bootstrap_of(df, "g", "id", "v", stats.average, 10, error=None).collect()}
    assert got["n"] == (None, None, None, 0) and got["nan"] == (None, None, None, 0) and got[None][0] == 2.0 and got["neg"][0] == -3.0
    assert stats.bootstrap_of(df.limit(0), "g", "id", "v", stats.average, 10).collect() == []
