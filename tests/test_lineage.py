import time

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import lineage


def test_registry_is_append_only(spark, tmp_path):
    path = str(tmp_path / "runs")
    a = lineage.append_run(spark, path, {"k1": 1.5, "b": 0.75}, {}, {"mrr": 0.5})
    b = lineage.append_run(spark, path, {"b": 0.75, "k1": 1.5}, {}, {})
    rows = {r["run_id"]: r["config_hash"] for r in lineage.runs(spark, path).collect()}
    assert set(rows) == {a, b} and rows[a] == rows[b]
    assert [lineage.record_touch(spark, str(tmp_path / "t"), "held_out", "x") for _ in range(2)] == [1, 2]


def test_resume_and_worksheet(spark):
    c, done = spark.range(5), spark.range(2)
    assert sorted(r[0] for r in lineage.pending(c, done, "id").collect()) == [2, 3, 4]
    lines = [r[0] for r in lineage.worksheet(c.where("id = 3").withColumn("note", F.lit(None).cast("string")), ["id", "note"], F.col("id").cast("string")).collect()]
    assert lines == ["## 3", "- id: 3", "verdict: ", ""]


def test_results_are_never_overwritten(spark, tmp_path):
    lineage.write_run(spark.range(2), str(tmp_path / "r"), {"a": 1})
    with pytest.raises(Exception, match="exists"):
        lineage.write_run(spark.range(2), str(tmp_path / "r"), {"a": 1})


def test_deadline(spark):
    slow = spark.range(0, 10**13, 1, 4).selectExpr("sum(hash(id))")
    began = time.time()
    with pytest.raises(TimeoutError):
        lineage.within(spark, 2, slow.collect)
    assert time.time() - began < 60
    assert lineage.within(spark, 60, spark.range(3).count) == 3
