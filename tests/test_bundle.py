import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import bundle


@pytest.fixture
def place(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "cases.jsonl").write_text('{"id": 1}\n')
    (tmp_path / "in" / "index.bin").write_bytes(b"x" * 5000)
    spark.range(10).coalesce(2).write.parquet(f"{tmp_path}/out")
    return tmp_path


def register(spark, place, **more):
    inputs = {"cases": f"{place}/in/cases.jsonl", "index": f"{place}/in/index.bin"}
    return bundle.register(spark, f"{place}/registry", {"k1": 1.5, "b": 0.75}, inputs, f"{place}/out", {"mrr": 0.5}, **more)


def states(df, column):
    return {(r["role"], r["path"].rsplit("/", 1)[-1].split("-")[0]): r[column] for r in df.collect()}


def test_digests_copies_and_the_run_last(spark, place):
    run = register(spark, place, most_bytes=1000)
    row = bundle.runs(spark, f"{place}/registry").first()
    assert row["run_id"] == run and row["config_hash"].startswith("cfg-") and row["source_hash"] == bundle.source()[1]
    got = bundle.verified(spark, f"{place}/registry", run).collect()
    by = {(r["role"], r["name"]): r for r in got if r["role"] == "input"}
    assert by["input", "cases"]["sha256"] == hashlib.sha256((place / "in" / "cases.jsonl").read_bytes()).hexdigest()
    assert by["input", "cases"]["copy"] == "ok" and by["input", "index"]["copy"] == "not_kept"
    assert sum(r["role"] == "result" for r in got) >= 2 and all(r["copy"] == "ok" for r in got if r["role"] != "input")
    kept = {(r["role"], r["name"]): bytes(r["content"]) for r in bundle.contents(spark, f"{place}/registry", run).where("role <> 'result'").collect()}
    assert kept["input", "cases"] == b'{"id": 1}\n'
    with zipfile.ZipFile(io.BytesIO(kept["source", "source.zip"])) as z:
        assert "palimpsest/operators/bundle.py" in z.namelist()


def test_appends_and_shares_blobs(spark, place):
    first, second = register(spark, place), register(spark, place)
    assert first != second and bundle.runs(spark, f"{place}/registry").count() == 2
    blobs = spark.read.parquet(f"{place}/registry/blobs")
    assert blobs.count() == blobs.select("sha256").distinct().count()
    assert {r["copy"] for r in bundle.verified(spark, f"{place}/registry", first).collect()} == {"ok"}


def test_damage_and_changes_show(spark, place):
    run = register(spark, place)
    assert set(states(bundle.compared(spark, f"{place}/registry", run), "now").values()) == {"same"}
    (place / "in" / "cases.jsonl").write_text('{"id": 2}\n')
    (place / "in" / "index.bin").unlink()
    now = states(bundle.compared(spark, f"{place}/registry", run), "now")
    assert now["input", "cases.jsonl"] == "changed" and now["input", "index.bin"] == "gone"
    assert {r["copy"] for r in bundle.verified(spark, f"{place}/registry", run).collect()} == {"ok"}  # the copies are as they were
    blobs = spark.read.parquet(f"{place}/registry/blobs").select("sha256", F.lit(b"other").alias("content"))
    blobs.write.parquet(f"{place}/damaged/blobs")
    for part in ("files", "runs"):
        (place / "damaged" / part).symlink_to(place / "registry" / part)
    assert {r["copy"] for r in bundle.verified(spark, f"{place}/damaged", run).collect()} == {"damaged"}


def test_a_registration_that_died_is_no_run(spark, place):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        bundle.register(spark, f"{place}/registry", {}, {"lost": f"{place}/in/none"}, f"{place}/out", {})
    register(spark, place)
    assert bundle.runs(spark, f"{place}/registry").count() == 1
    with pytest.raises(KeyError):
        bundle.verified(spark, f"{place}/registry", "no such run")


def test_source_hash_has_no_clock():
    assert bundle.source() == bundle.source()
