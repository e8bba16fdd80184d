import json
import time

import pytest

from palimpsest.operators import service, trace


def test_spans_without_a_trace_do_nothing(spark, tmp_path):
    with trace.span("alone", a=1) as attrs:
        attrs["b"] = 2
        assert spark.range(3).count() == 3
    assert attrs == {"a": 1, "b": 2} and list(tmp_path.iterdir()) == []


def inner(spark):
    with trace.span("count", kind="inner") as attrs:
        attrs["n"] = spark.range(100).repartition(3).count()
        time.sleep(0.05)


def test_nested_spans_of_one_trace(spark, tmp_path):
    path = str(tmp_path / "spans")
    with trace.request(spark, path, "query", query="brca1") as trace_id:
        inner(spark)
        with trace.span("nothing"):
            pass
        spark.range(5).count()
    rows = {r["name"]: r for r in trace.spans(spark, path).collect()}
    assert set(rows) == {"query", "count", "nothing"} and {r["trace_id"] for r in rows.values()} == {trace_id}
    root = rows["query"]
    assert root["parent_span_id"] is None and {rows[n]["parent_span_id"] for n in ("count", "nothing")} == {root["span_id"]}
    assert json.loads(root["attributes"]) == {"query": "brca1"} and json.loads(rows["count"]["attributes"]) == {"kind": "inner", "n": 100}
    assert rows["count"]["jobs"] >= 1 and rows["count"]["tasks"] >= 3 and rows["nothing"]["jobs"] == 0 and root["jobs"] >= 1
    assert root["duration_ms"] >= rows["count"]["duration_ms"] >= 50
    own = {r["name"]: r for r in service.self_times(trace.self_time_input(trace.spans(spark, path))).collect()}
    assert own["query"]["self_ms"] == pytest.approx(root["duration_ms"] - rows["count"]["duration_ms"] - rows["nothing"]["duration_ms"])


def test_traces_append_and_failures_are_written(spark, tmp_path):
    path = str(tmp_path / "spans")
    for _ in range(2):
        with pytest.raises(ZeroDivisionError), trace.request(spark, path, "query"), trace.span("part"):
            1 / 0  # noqa: B018
    rows = trace.spans(spark, path).collect()
    assert len(rows) == 4 and len({r["trace_id"] for r in rows}) == 2
    assert all(json.loads(r["attributes"]) == {"error": "ZeroDivisionError"} for r in rows)
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
