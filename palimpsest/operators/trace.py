"""Spans of what the driver does, with the Spark work of each, as an append-only table of JSON lines.

A request opens a trace; spans nest inside it, also across functions that know nothing of tracing, and carry
how many jobs, stages and tasks their block ran itself. A trace is written once, when its request ends;
without a trace a span does nothing. ``service.self_times`` reads what comes out.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = "trace_id string, span_id string, parent_span_id string, name string, start string, duration_ms double, jobs int, stages int, tasks int, attributes string"

_current: ContextVar[_Trace | None] = ContextVar("trace", default=None)


class _Trace:
    def __init__(self, spark: SparkSession):
        self.spark, self.id = spark, uuid.uuid4().hex
        self.stack: list[str] = []
        self.done: list[tuple] = []


@contextmanager
def request(spark: SparkSession, path: str, name: str, **attributes) -> Iterator[str]:
    """A trace and its root span, appended to the table at ``path`` when the block ends, however it ends;
    yields the trace's id."""
    trace = _Trace(spark)
    token = _current.set(trace)
    try:
        with span(name, **attributes):
            yield trace.id
    finally:
        _current.reset(token)
        spark.createDataFrame(trace.done, SPANS).coalesce(1).write.mode("append").json(path)


@contextmanager
def span(name: str, **attributes) -> Iterator[dict]:
    """Times the block and counts its Spark work; yields the attributes, to which the block may add. A block
    that fails has ``error``. Jobs of an inner span count there only."""
    trace = _current.get()
    if trace is None:
        yield dict(attributes)
        return
    sc, span_id = trace.spark.sparkContext, uuid.uuid4().hex[:16]
    parent = trace.stack[-1] if trace.stack else None
    before = sc.getLocalProperty("spark.jobGroup.id")
    trace.stack.append(span_id)
    sc.setLocalProperty("spark.jobGroup.id", span_id)
    attrs, start, began = dict(attributes), datetime.now(UTC).isoformat(), time.monotonic()
    try:
        yield attrs
    except BaseException as e:
        attrs["error"] = type(e).__name__
        raise
    finally:
        ms = round(1000 * (time.monotonic() - began), 3)
        trace.stack.pop()
        sc.setLocalProperty("spark.jobGroup.id", before)
        trace.done.append((trace.id, span_id, parent, name, start, ms, *_work(sc, span_id), json.dumps(attrs, sort_keys=True, default=str)))


def _work(sc, group: str) -> tuple[int, int, int]:
    tracker = sc.statusTracker()
    jobs = tracker.getJobIdsForGroup(group)
    stages = {s for j in jobs if (info := tracker.getJobInfo(j)) for s in info.stageIds}
    ran = [info for s in stages if (info := tracker.getStageInfo(s)) and info.numCompletedTasks]
    return len(jobs), len(ran), sum(s.numCompletedTasks for s in ran)


def spans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPANS).json(path)


def self_time_input(rows: DataFrame) -> DataFrame:
    """Spans as ``service.self_times`` takes them."""
    return rows.select("span_id", F.col("parent_span_id").alias("parent"), "name", F.col("duration_ms").alias("ms"))
