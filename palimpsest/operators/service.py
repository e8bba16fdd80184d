"""What request logs, traces and review tables say: counts, latencies, gates and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import rate, wilson


def latencies(requests: DataFrame, keys: list[str], value: str, at: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(keys, n, p50, p95, per_second): exact percentiles by linear interpolation, and the throughput
    between the first and the last request (null if all came at once)."""
    micros = lambda f: F.unix_micros(f(F.col(at).cast("timestamp")))
    seconds = (micros(F.max) - micros(F.min)) / 1e6
    percentiles = [F.percentile(value, s).alias(f"p{round(100 * s)}") for s in shares]
    return requests.groupBy(*keys).agg(F.count("*").alias("n"), *percentiles, (F.count("*") / F.nullif(seconds, F.lit(0.0))).alias("per_second"))


def outcomes(requests: DataFrame, outcome: str, value: str, user: str) -> DataFrame:
    """(outcome, n, mean_ms, users)"""
    return requests.groupBy(F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"), F.avg(value).alias("mean_ms"), F.count_distinct(user).alias("users"))


def self_times(spans: DataFrame) -> DataFrame:
    """(name, n, total_ms, self_ms) of spans (span_id, parent, name, ms): what a span takes itself is its
    time less its children's."""
    inner = spans.where("parent is not null").groupBy(F.col("parent").alias("span_id")).agg(F.sum("ms").alias("inner_ms"))
    own = F.col("ms") - F.coalesce("inner_ms", F.lit(0.0))
    return spans.join(inner, "span_id", "left").groupBy("name").agg(F.count("*").alias("n"), F.sum("ms").alias("total_ms"), F.sum(own).alias("self_ms"))


def protocol_faults(lines: DataFrame) -> DataFrame:
    """(stream, after_summary, failed, summaries) of streams' lines (stream, seq, kind): everything that
    follows a stream's first summary breaks the protocol, and so does an error."""
    first = F.min(F.when(F.col("kind") == "summary", F.col("seq"))).over(Window.partitionBy("stream"))
    late = F.coalesce(F.col("seq") > F.col("first"), F.lit(False))
    return lines.withColumn("first", first).groupBy("stream").agg(F.sum(late.cast("long")).alias("after_summary"), F.bool_or(F.col("kind") == "error").alias("failed"), F.count_if(F.col("kind") == "summary").alias("summaries"))


def release_counts(cases: DataFrame, key: str, status: Column, rejected: str, unreviewed: str) -> DataFrame:
    """One row that a release must meet: cases, duplicate_ids, rejected, unreviewed."""
    n = lambda s, name: F.coalesce(F.sum((status == s).cast("long")), F.lit(0)).alias(name)
    return cases.agg(F.count("*").alias("cases"), (F.count("*") - F.count_distinct(key)).alias("duplicate_ids"), n(rejected, "rejected"), n(unreviewed, "unreviewed"))


def majority(rows: DataFrame, value: str) -> DataFrame:
    """(value, rate, n): the most frequent value, of equal ones the greatest; nulls don't count."""
    c = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    return c.agg(F.max_by(value, F.struct("c", value)).alias("value"), (F.max("c") / F.sum("c")).alias("rate"), F.sum("c").alias("n"))


def reasons(rows: DataFrame, reason: Column) -> DataFrame:
    """(reason, n): counts by what stands before the first colon."""
    return rows.groupBy(F.substring_index(reason, ":", 1).alias("reason")).agg(F.count("*").alias("n"))


def overlap_profile(rows: DataFrame, style: str, overlap: Column, high: Column) -> DataFrame:
    """(style, mean, median, high): how much of the queries' words their paragraphs hold, and the share of
    rows that count as ``high`` (usually 0.9 or more)."""
    return rows.groupBy(F.col(style).alias("style")).agg(F.avg(overlap).alias("mean"), F.percentile(overlap, 0.5).alias("median"), F.avg(high.cast("int")).alias("high"))


def threshold_grid(rows: DataFrame, verdict: str, rank: str, margin: str, grid: DataFrame) -> DataFrame:
    """(verdict, max_rank, min_margin, n, rejected, median): rejects for each pair of thresholds, and the
    upper median of the margins (rank n // 2 + 1), from counts of values, so that no group is collected."""
    counts = rows.groupBy(verdict, margin).agg(F.count("*").alias("c"))
    of = Window.partitionBy(verdict)
    upto, total = F.sum("c").over(of.orderBy(margin)), F.sum("c").over(of)
    median = counts.select(verdict, margin, upto.alias("u"), total.alias("t")).where(F.col("u") > F.floor(F.col("t") / 2)).groupBy(verdict).agg(F.min(margin).alias("median"))
    bad = (F.col(rank) > F.col("max_rank")) | (F.col(margin) < F.col("min_margin"))
    out = rows.join(grid).groupBy(verdict, "max_rank", "min_margin").agg(F.count("*").alias("n"), F.sum(bad.cast("long")).alias("rejected"))
    return out.join(median, verdict).withColumnRenamed(verdict, "verdict")


def worksheet_verdicts(lines: DataFrame, heading: Column, verdict: Column) -> DataFrame:
    """(sheet, case_id, verdict) of worksheet lines (sheet, line_no, ...): a verdict line belongs to the
    last heading before it, of several the last counts; a case without any stays out."""
    w = Window.partitionBy("sheet").orderBy("line_no")
    held = lines.withColumn("case_id", F.last(heading, ignorenulls=True).over(w)).withColumn("verdict", verdict)
    return held.where("case_id is not null and verdict is not null").groupBy("sheet", "case_id").agg(F.max_by("verdict", "line_no").alias("verdict"))


def worksheet_error_rate(verdicts: DataFrame) -> DataFrame:
    """One row (cases, valid, wrong, unsure, unfilled, wrong_rate, ci_low, ci_high): the interval is that of
    the wrong ones among those filled in; anything but the three verdicts is unfilled."""
    n = lambda v: F.coalesce(F.sum((F.col("verdict") == v).cast("long")), F.lit(0)).alias(v)
    t = verdicts.agg(F.count("*").alias("cases"), n("valid"), n("wrong"), n("unsure")).withColumn("filled", F.col("valid") + F.col("wrong") + F.col("unsure"))
    low, high = wilson(F.col("wrong"), F.col("filled"))
    return t.select("cases", "valid", "wrong", "unsure", (F.col("cases") - F.col("filled")).alias("unfilled"), rate(F.col("wrong"), F.col("filled")).alias("wrong_rate"), low.alias("ci_low"), high.alias("ci_high"))


def hole_rate(hits: DataFrame, answers: Column) -> DataFrame:
    """One row (n, holes, value, ci_low, ci_high) of the first hits (query_id, gold, ...) of each query:
    the share of queries where a hit other than gold also ``answers``. Queries whose hits and index hold
    no gold aren't judged; give hits of the others only."""
    h = hits.groupBy("query_id").agg(F.coalesce(F.bool_or(~F.col("gold") & answers), F.lit(False)).alias("hole"))
    t = h.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("hole").cast("long")), F.lit(0)).alias("holes"))
    low, high = wilson(F.col("holes"), F.col("n"))
    return t.select("n", "holes", F.coalesce(rate(F.col("holes"), F.col("n")), F.lit(0.0)).alias("value"), low.alias("ci_low"), high.alias("ci_high"))
