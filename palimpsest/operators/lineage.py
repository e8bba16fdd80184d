"""Runs, resumption and deadlines: the thin driver side around DataFrame jobs."""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "run_id string, config_hash string, config string, inputs string, metrics string, created_at_utc string"
TOUCHES = "split string, reason string, touched_at_utc string"
MOST_TOUCHES = 3


def config_hash(config: dict) -> str:
    """A name for a configuration that doesn't depend on the order of its keys."""
    return "cfg-" + hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def now() -> str:
    return datetime.now(UTC).isoformat()


def append_run(spark: SparkSession, path: str, config: dict, inputs: dict, metrics: dict) -> str:
    """Adds one row to the registry, an append-only JSON table; earlier rows never change."""
    run_id = uuid.uuid4().hex
    row = (run_id, config_hash(config), *(json.dumps(x, sort_keys=True) for x in (config, inputs, metrics)), now())
    spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").json(path)
    return run_id


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).json(path)


def record_touch(spark: SparkSession, path: str, split: str, reason: str) -> int:
    """Notes that a held-out split was looked at; returns how often that was, this time included."""
    spark.createDataFrame([(split, reason, now())], TOUCHES).coalesce(1).write.mode("append").json(path)
    return spark.read.schema(TOUCHES).json(path).where(F.col("split") == split).count()


def write_run(results: DataFrame, path: str, config: dict) -> None:
    """Results as JSON lines and what made them beside them; refuses to overwrite."""
    results.write.mode("errorifexists").json(f"{path}/results")
    results.sparkSession.createDataFrame([(config_hash(config), json.dumps(config, sort_keys=True), now())], "config_hash string, config string, created_at_utc string").coalesce(1).write.mode("errorifexists").json(f"{path}/meta")


def pending(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What an interrupted build has still to do."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")


def worksheet(cases: DataFrame, fields: list[str], heading: Column) -> DataFrame:
    """(line) of a worksheet: a heading, a line for each field that isn't null, a place for the verdict."""
    parts = [F.concat(F.lit("## "), heading), *[F.concat(F.lit(f"- {f}: "), F.col(f).cast("string")) for f in fields], F.lit("verdict: "), F.lit("")]
    return cases.select(F.explode(F.array_compact(F.array(*parts))).alias("line"))


def within(spark: SparkSession, seconds: float, action: Callable[[], object]) -> object:
    """The action's result; TimeoutError if its Spark jobs take longer, which are then cancelled."""
    group, sc = f"deadline-{uuid.uuid4().hex}", spark.sparkContext
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(group, "within a deadline", interruptOnCancel=True)
    timer.start()
    try:
        out = action()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"more than {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    if late.is_set():
        raise TimeoutError(f"more than {seconds} seconds")
    return out
