import json
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import index, lineage, sampling, service, serving

TEXTS = [(i, f"gene{i % 7} variant risk in study {i}") for i in range(40)]


@pytest.fixture(scope="module")
def search(spark):
    stored = index.build(spark.createDataFrame(TEXTS, "chunk_ord long, text string"))
    return lambda queries: index.search(stored, queries, 20)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "gene3 risk"), (2, "..."), (3, "nothing here"), (4, "gene5")], "query_id long, query string")


def streams(lines):
    out = {}
    for r in sorted(lines.collect(), key=lambda r: (r["query_id"], r["seq"])):
        out.setdefault(r["query_id"], []).append(json.loads(r["line"]))
    return out


def test_streams_errors_and_log(spark, search, queries):
    got = serving.serve(spark, search, [(queries.where("query_id < 3"), 300.0), (queries.where("query_id = 3"), 300.0), (queries.where("query_id = 4"), 0.0)], 2)
    s = streams(got.lines)
    assert [x["type"] for x in s[1]] == ["match"] * 5 + ["summary"] and s[1][-1] == {"type": "summary", "n_matches": 5, "candidates_scanned": 20, "stopped_reason": "max_matches"}
    assert [x["type"] for x in s[2]] == ["not_found", "summary"] and s[2][-1]["stopped_reason"] == "no_query_words"
    assert s[3][-1]["stopped_reason"] == "exhausted" and s[3][-1]["n_matches"] == 0
    assert s[4] == [{"type": "error", "code": "deadline"}, {"type": "summary", "n_matches": 0, "candidates_scanned": 0, "stopped_reason": "deadline"}]
    log = {r["batch"]: r for r in got.log.collect()}
    assert [log[k]["stopped_reason"] for k in range(3)] == ["finished", "finished", "deadline"] and log[0]["queries"] == 2
    assert all(0 < r["first_ms"] <= r["total_ms"] for r in log.values())
    kinds = got.lines.select(F.col("query_id").alias("stream"), "seq", F.get_json_object("line", "$.type").alias("kind"))
    faults = {r["stream"]: r for r in service.protocol_faults(kinds).collect()}
    assert all(r["after_summary"] == 0 and r["summaries"] == 1 for r in faults.values()) and [i for i, r in faults.items() if r["failed"]] == [4]


def test_load_run(spark, search, queries):
    many = queries.unionByName(queries.select((F.col("query_id") + 10).alias("query_id"), "query"))
    log = serving.load_run(spark, search, many, 3, 300.0, 2)
    r = serving.report(log).first()
    assert r["batches"] == 3 and r["failed"] == 0 and r["queries"] == 8 and 0 < r["first_p50_ms"] <= r["p95_ms"]


def test_deadlines(spark):
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        lineage.within(spark, 1.0, lambda: spark.range(4).repartition(4).selectExpr("java_method('java.lang.Thread', 'sleep', 60000L)").collect())
    assert time.monotonic() - began < 50
    assert lineage.within(spark, 60, lambda: spark.range(3).count()) == 3


def test_health():
    assert serving.health(None)[0] == 503 and serving.health(0)[0] == 503 and serving.health(3)[0] == 200


def test_ranks_in_large_strata_are_spread(spark):
    rows = spark.range(40_000).selectExpr("id", "if(id % 10 = 0, null, cast(id % 2 as string)) as s").repartition(4)
    got = sampling.ranked(rows, "s", "id")
    by = {}
    for r in got.select("s", "id", "_r", F.md5(F.concat(F.lit("0:"), F.col("id").cast("string"))).alias("h")).collect():
        by.setdefault(r["s"], []).append((r["h"], r["id"], r["_r"]))
    assert len(by) == 3 and all([x[2] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())
    few = sampling.round_robin(rows, "s", "id", 7)
    assert sorted((r["s"] or "") for r in few.collect()) == sorted(["", "", "", "0", "0", "1", "1"])
    one = sampling.each_and_more(rows.unionByName(rows.limit(1).selectExpr("id + 50000 as id", "'rare' as s")), "s", "id", 5)
    assert {r["s"] for r in one.collect()} == {None, "0", "1", "rare"}
