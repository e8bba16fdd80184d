"""What made a run, kept beside it: digests of all inputs and results, copies of what is small.

Files are read by Spark, hashed where they are read, and copied into a table that is addressed by content:
a blob that is there already isn't written again. The run's row is committed last, so a registration that
died leaves no run. Verification joins digests: of the kept blobs, and of the files as they are now.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ROOT
from .lineage import config_hash, now

FILES = "role string, name string, path string, sha256 string, length long, kept boolean"
BLOBS = "sha256 string, content binary"
RUNS = "run_id string, config_hash string, config string, source_hash string, results_path string, metrics string, created_at_utc string"
#: Larger inputs are digested and not kept; they can be made again. Results are always kept.
MOST_BYTES = 10 << 20


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def files(spark: SparkSession, role: str, name: str, path: str) -> DataFrame:
    """(role, name, path, sha256, length, content) of a file or of all files below a folder (up to 2 GB
    each), but for markers and hidden ones."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.lit(role).alias("role"), F.lit(name).alias("name"), "path", F.sha2("content", 256).alias("sha256"), "length", "content")


def source() -> tuple[bytes, str]:
    """(the package's files as an archive, a digest of their names and contents that no clock changes)."""
    names = sorted((ROOT / "palimpsest").rglob("*.py"))
    archive, digest = io.BytesIO(), hashlib.sha256()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in names:
            data, name = f.read_bytes(), f.relative_to(ROOT).as_posix()
            digest.update(f"{len(name)}:{name}{len(data)}:".encode() + data)
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return archive.getvalue(), digest.hexdigest()[:12]


def register(spark: SparkSession, registry: str, config: dict, inputs: dict[str, str], results: str, metrics: dict, most_bytes: int = MOST_BYTES) -> str:
    """Adds a run to ``registry``, a folder that all machines share; returns its id.

    inputs: names and the files or folders that they stand for; results: what the run wrote. RuntimeError if
    a file changes while it is being registered. Earlier runs never change.
    """
    run_id = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ") + "-" + uuid.uuid4().hex
    archive, source_hash = source()
    snapshot = spark.createDataFrame([("source", "source.zip", "", hashlib.sha256(archive).hexdigest(), len(archive), archive)], "role string, name string, path string, sha256 string, length long, content binary")
    every = snapshot.unionByName(files(spark, "result", "results", results))
    for name, path in inputs.items():
        every = every.unionByName(files(spark, "input", name, path))
    small = (F.col("role") != "input") | (F.col("length") <= most_bytes)
    every.select("role", "name", "path", "sha256", "length", small.alias("kept")).write.mode("errorifexists").parquet(f"{registry}/files/run_id={run_id}")
    listed = spark.read.schema(FILES).parquet(f"{registry}/files/run_id={run_id}")
    have = _read(spark, f"{registry}/blobs", BLOBS).select("sha256")
    fresh = every.where(small).select("sha256", "content").dropDuplicates(["sha256"]).join(have, "sha256", "left_anti")
    fresh.write.mode("append").parquet(f"{registry}/blobs")
    # what is listed must be what was copied: a file that changed in between has another digest
    lost = listed.where("kept").join(_read(spark, f"{registry}/blobs", BLOBS).select("sha256"), "sha256", "left_anti")
    now_ = every.where("role <> 'source'").select("path", "sha256")
    changed = listed.where("role <> 'source'").select("path", F.col("sha256").alias("was")).join(now_, "path", "left").where("sha256 is null or sha256 <> was")
    if not lost.isEmpty() or not changed.isEmpty():
        raise RuntimeError("a file changed during registration")
    row = (run_id, config_hash(config), json.dumps(config, sort_keys=True), source_hash, results, json.dumps(metrics, sort_keys=True), now())
    spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").json(f"{registry}/runs")
    return run_id


def runs(spark: SparkSession, registry: str) -> DataFrame:
    return spark.read.schema(RUNS).json(f"{registry}/runs")


def listed(spark: SparkSession, registry: str, run_id: str) -> DataFrame:
    """(role, name, path, sha256, length, kept) of a run that was committed; KeyError for others."""
    if runs(spark, registry).where(F.col("run_id") == run_id).isEmpty():
        raise KeyError(run_id)
    return spark.read.schema(FILES).parquet(f"{registry}/files/run_id={run_id}")


def verified(spark: SparkSession, registry: str, run_id: str) -> DataFrame:
    """(role, name, path, sha256, copy): the kept copies against their digests: ok, damaged, missing, or
    not_kept."""
    blobs = _read(spark, f"{registry}/blobs", BLOBS).groupBy("sha256").agg(F.bool_or(F.sha2("content", 256) == F.col("sha256")).alias("whole"))
    copy = F.when(~F.col("kept"), "not_kept").when(F.col("whole").isNull(), "missing").when(F.col("whole"), "ok").otherwise("damaged")
    return listed(spark, registry, run_id).join(blobs, "sha256", "left").select("role", "name", "path", "sha256", copy.alias("copy"))


def compared(spark: SparkSession, registry: str, run_id: str) -> DataFrame:
    """(role, name, path, now): a run's files against the places they came from: same, changed, gone, new."""
    was = listed(spark, registry, run_id).where("role <> 'source'")
    results = runs(spark, registry).where(F.col("run_id") == run_id).first()["results_path"]
    is_ = None
    for role, name in [tuple(r) for r in was.select("role", "name").distinct().collect()]:
        paths = [r["path"] for r in was.where((F.col("role") == role) & (F.col("name") == name)).select("path").limit(2).collect()]
        top = results if role == "result" else paths[0] if len(paths) == 1 else paths[0].rsplit("/", 1)[0]
        try:
            found = files(spark, role, name, top).select("role", "name", "path", F.col("sha256").alias("is"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        is_ = found if is_ is None else is_.unionByName(found)
    if is_ is None:
        return was.select("role", "name", "path", F.lit("gone").alias("now"))
    state = F.when(F.col("is").isNull(), "gone").when(F.col("sha256").isNull(), "new").when(F.col("is") == F.col("sha256"), "same").otherwise("changed")
    return was.join(is_, ["role", "name", "path"], "full").select("role", "name", "path", state.alias("now"))


def contents(spark: SparkSession, registry: str, run_id: str) -> DataFrame:
    """(role, name, path, content) of a run's kept files, as they were."""
    blobs = _read(spark, f"{registry}/blobs", BLOBS).dropDuplicates(["sha256"])
    return listed(spark, registry, run_id).where("kept").join(blobs, "sha256").select("role", "name", "path", "content")
