"""Serving searches in batches: a deadline for each, lines of the stream protocol, a log, and load runs.

A batch is one Spark job over a table of queries. Batches run side by side in pools of their own, so that a
large one doesn't hold up the others (pools share fairly where ``spark.scheduler.mode`` is FAIR). What a
batch finds is written before it is read, so its lines come from whole results or from none.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import sampling
from .lineage import within
from .tables import kept

#: A search: (query_id, query) -> (query_id, rank, chunk_ord, ...), ranked from 1, at most so many as are scanned.
Search = Callable[[DataFrame], DataFrame]
MOST_MATCHES = 5

LINES = "query_id long, seq int, line string"
LOG = "batch int, queries long, first_ms double, total_ms double, stopped_reason string"


def health(n_chunks: int | None) -> tuple[int, str]:
    """(status, text): ready only when an index is there and holds chunks."""
    return (200, "ok") if n_chunks else (503, "corpus not loaded")


def lines(queries: DataFrame, hits: DataFrame | None, most: int = MOST_MATCHES) -> DataFrame:
    """(query_id, seq, line): the stream of each query. Without ``hits`` its batch ran into the deadline: an
    error line and a summary that says so. Else its first matches, or one line that there are none, and a
    summary, which is always the last line."""
    q = queries.select("query_id", "query")
    if hits is None:
        error = q.select("query_id", F.lit(0).alias("kind"), F.lit(0).alias("place"), F.lit('{"type":"error","code":"deadline"}').alias("line"))
        end = F.to_json(F.struct(F.lit("summary").alias("type"), F.lit(0).alias("n_matches"), F.lit(0).alias("candidates_scanned"), F.lit("deadline").alias("stopped_reason")))
        every = error.unionByName(q.select("query_id", F.lit(2).alias("kind"), F.lit(0).alias("place"), end.alias("line")))
    else:
        shown = hits.where(F.col("rank") <= most)
        line = F.to_json(F.struct(F.lit("match").alias("type"), F.col("rank").cast("int").alias("rank"), F.col("chunk_ord").alias("pmcid")))
        match = shown.select("query_id", F.lit(0).alias("kind"), F.col("rank").cast("int").alias("place"), line.alias("line"))
        n = q.join(hits.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        none = n.where("n = 0").select("query_id", F.lit(1).alias("kind"), F.lit(0).alias("place"), F.lit('{"type":"not_found","candidates_scanned":0}').alias("line"))
        reason = F.when(F.size(T.tokens(F.col("query"))) == 0, "no_query_words").when(F.col("n") > most, "max_matches").otherwise("exhausted")
        end = F.to_json(F.struct(F.lit("summary").alias("type"), F.least("n", F.lit(most)).cast("long").alias("n_matches"), F.col("n").alias("candidates_scanned"), reason.alias("stopped_reason")))
        every = match.unionByName(none).unionByName(n.select("query_id", F.lit(2).alias("kind"), F.lit(0).alias("place"), end.alias("line")))
    return every.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("kind", "place")).alias("seq"), "line")


@dataclass
class Served:
    """lines: (query_id, seq, line) of all batches; log: LOG, one row a batch."""

    lines: DataFrame
    log: DataFrame


def serve(spark: SparkSession, search: Search, batches: list[tuple[DataFrame, float]], concurrency: int = 4, most: int = MOST_MATCHES) -> Served:
    """Runs batches (queries, seconds it may take) side by side. A batch beyond its deadline is cancelled and
    answered by error lines; one that fails for another reason fails the run."""
    done: dict[int, tuple] = {}
    lock = threading.Lock()

    def one(number: int) -> None:
        queries, seconds = batches[number]
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"batch-{number % concurrency}")
        began, hits, first, reason = time.monotonic(), None, None, "deadline"
        try:
            hits = within(spark, seconds, lambda: kept(search(queries), "hits"))
            next(iter(hits.limit(1).collect()), None)
            first, reason = time.monotonic() - began, "finished"
        except TimeoutError:
            hits = None
        out = kept(lines(queries, hits, most), "lines")
        n = queries.count()
        total = time.monotonic() - began
        with lock:
            done[number] = (out, (number, n, round(1000 * (first or total), 1), round(1000 * total, 1), reason))

    with ThreadPoolExecutor(concurrency) as pool:
        for f in [pool.submit(inheritable_thread_target(spark)(one), k) for k in range(len(batches))]:
            f.result()
    log = spark.createDataFrame([done[k][1] for k in sorted(done)], LOG)
    every = spark.createDataFrame([], LINES)
    for k in sorted(done):
        every = done[k][0] if k == 0 else every.unionByName(done[k][0])
    return Served(every, log)


def load_run(spark: SparkSession, search: Search, queries: DataFrame, batch_size: int, seconds: float, concurrency: int = 4, seed: int = 0) -> DataFrame:
    """LOG of a load run: ``queries`` in an order by hash, in batches of ``batch_size``, ``concurrency`` at a
    time. The order is spread over (query_id) ranges of the hash, never on the driver."""
    n = queries.count()
    number = max(1, -(-n // batch_size))
    dealt = kept(queries.withColumn("batch", F.pmod(F.xxhash64(sampling.shuffle_key("query_id", seed)), F.lit(number)).cast("int")), "load")
    return serve(spark, search, [(dealt.where(F.col("batch") == b).drop("batch"), seconds) for b in range(number)], concurrency).log


def report(log: DataFrame) -> DataFrame:
    """One row (batches, failed, queries, p50_ms, p95_ms, first_p50_ms) of a load run's log."""
    ok = F.col("stopped_reason") == "finished"
    p = lambda c, s: F.percentile(F.when(ok, F.col(c)), s)
    return log.agg(F.count("*").alias("batches"), F.count_if(~ok).alias("failed"), F.sum("queries").alias("queries"), p("total_ms", 0.5).alias("p50_ms"), p("total_ms", 0.95).alias("p95_ms"), p("first_ms", 0.5).alias("first_p50_ms"))
