from pyspark.sql import functions as F

from palimpsest.streaming import requests
from tests.conftest import SF


def test_stream_equals_batch_for_closed_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    log = str(tmp_path / "log")
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(log)
    stream = requests.outcome_windows(requests.read_log(spark, log, events.schema), late="10 minutes")
    got = {(r["window_start"], r["outcome"]): (r["n"], round(r["total_ms"], 6)) for r in requests.drained(stream, str(tmp_path / "out"), str(tmp_path / "state")).collect()}
    batch = {(r["window_start"], r["outcome"]): (r["n"], round(r["total_ms"], 6)) for r in requests.outcome_windows(events).collect()}
    end = events.agg(F.max("ts")).first()[0]
    assert got and all(batch[k] == v for k, v in got.items())
    assert len(batch) - len(got) <= len({k for k in batch if (end - k[0].replace(tzinfo=None)).total_seconds() < 7200})
