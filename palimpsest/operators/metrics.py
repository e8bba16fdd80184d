"""Ranking metrics over long tables: run (query_id, rank, doc_id) and qrels (query_id, doc_id, rel).

Undefined is null, not zero: a query without relevant documents has no recall and no nDCG, but a
reciprocal rank of 0. Unjudged documents gain nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import rate, wilson


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.join(qrels.select("query_id", "doc_id", "rel"), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def per_query(run: DataFrame, qrels: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (5, 10, 100), ndcg_k: int = 10) -> DataFrame:
    """One row a query: recall@k for each k, ndcg@ndcg_k and mrr."""
    gain = F.col("rel") / F.log2(F.col("rank") + 1.0)
    hits = judged(run, qrels).groupBy("query_id").agg(
        *[F.sum(F.when((F.col("rank") <= k) & (F.col("rel") > 0), 1).otherwise(0)).alias(f"h{k}") for k in ks],
        F.sum(F.when(F.col("rank") <= ndcg_k, gain)).alias("dcg"),
        F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"),
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    ideal = qrels.where("rel > 0").withColumn("r", F.row_number().over(best))
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("n_rel"), F.sum(F.when(F.col("r") <= ndcg_k, F.col("rel") / F.log2(F.col("r") + 1.0))).alias("idcg"))
    out = queries.select("query_id").join(hits, "query_id", "left").join(ideal, "query_id", "left")
    recall = [F.when(F.col("n_rel") > 0, F.coalesce(f"h{k}", F.lit(0)) / F.col("n_rel")).alias(f"recall@{k}") for k in ks]
    ndcg = F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias(f"ndcg@{ndcg_k}")
    return out.select("query_id", *recall, ndcg, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def long(table: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, metric, value) of a table with one column a metric."""
    return table.unpivot([key], [c for c in table.columns if c != key], "metric", "value")


def means(values: DataFrame) -> DataFrame:
    """(metric, value, n): means of what is defined; 0.0 with n = 0 if nothing is."""
    return values.groupBy("metric").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("value"), F.count("value").alias("n"))


def relabel_gold(hits: DataFrame) -> DataFrame:
    """(query_id, rank, doc_id, gold) -> ranks closed up after gold hits beyond the first are dropped."""
    first = F.min(F.when(F.col("gold"), F.col("rank"))).over(Window.partitionBy("query_id"))
    kept = hits.withColumn("_first", first).where(~F.col("gold") | (F.col("rank") == F.col("_first")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.select("query_id", rank.alias("rank"), F.when(F.col("gold"), F.lit("GOLD")).otherwise(F.col("doc_id").cast("string")).alias("doc_id"))


def share_by(rows: DataFrame, keys: list[str], hit: Column, least: int = 0) -> DataFrame:
    """(keys, value, ci_low, ci_high, n): share of hits with its interval; groups under ``least`` go."""
    out = rows.groupBy(*keys).agg(F.sum(hit.cast("long")).alias("s"), F.count("*").alias("n")).where(F.col("n") >= least)
    low, high = wilson(F.col("s"), F.col("n"))
    return out.select(*keys, F.round(rate(F.col("s"), F.col("n")), 4).alias("value"), F.round(low, 4).alias("ci_low"), F.round(high, 4).alias("ci_high"), "n")


def kappa(pairs: DataFrame, a: str, b: str, levels: tuple[str, ...]) -> DataFrame:
    """One row (n, unweighted, weighted): agreement of two raters over ordered levels, linear weights;
    NaN where chance agreement is complete. One pre-aggregated contingency table, no collection."""
    code = lambda c: F.array_position(F.array(*map(F.lit, levels)), F.col(c)) - 1
    far = F.lit(max(1, len(levels) - 1))
    cell = pairs.select(code(a).alias("i"), code(b).alias("j")).groupBy("i", "j").agg(F.count("*").alias("c"))
    rows, cols = cell.groupBy("i").agg(F.sum("c").alias("r")), cell.groupBy("j").agg(F.sum("c").alias("q"))
    seen = cell.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("i") == F.col("j"), F.col("c")).otherwise(0)).alias("o"), F.sum(F.col("c") * (1 - F.abs(F.col("i") - F.col("j")) / far)).alias("ow"))
    chance = rows.join(cols).agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("r") * F.col("q")).otherwise(0)).alias("e"), F.sum(F.col("r") * F.col("q") * (1 - F.abs(F.col("i") - F.col("j")) / far)).alias("ew"))
    n = F.col("n").cast("double")
    of = lambda o, e: F.when(F.col(e) / (n * n) >= 1, F.lit(float("nan"))).otherwise((F.col(o) / n - F.col(e) / (n * n)) / F.nullif(1 - F.col(e) / (n * n), F.lit(0.0)))
    return seen.join(chance).select("n", of("o", "e").alias("unweighted"), of("ow", "ew").alias("weighted"))


#: How a kappa is read, from which value on; below the first likewise.
BANDS = ((0.0, "no better than chance / slight"), (0.2, "fair"), (0.4, "moderate"), (0.6, "substantial"), (0.8, "almost perfect"))


def agreement(kappa: Column) -> Column:
    """The textbook reading of a kappa; null where it is undefined (null or NaN)."""
    out = F.lit(BANDS[0][1])
    for least, name in BANDS[1:]:
        out = F.when(kappa >= least, name).otherwise(out)
    return F.when(kappa.isNotNull() & ~F.isnan(kappa), out)
