"""Sources behind a network: a paged search as a Spark data source, and a fetch that resumes by digest.

The transport is injected, so any client (or a folder, in tests) serves. A search becomes partitions of
pages, read side by side; a fetch asks for each article once, keeps what failed with the reason, and
commits its manifest last.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.judging import Busy
from ..session import ship

#: Ids of a page, articles of one request for metadata.
PAGE, BATCH = 10_000, 200
TRIES = 4


class Search(Protocol):
    """A search service. ``total`` opens a search and tells how much it finds and by which token its pages
    are asked for."""

    def total(self, query: str) -> tuple[int, str]: ...

    def page(self, token: str, start: int, size: int) -> list[str]: ...


class Store(Protocol):
    """An object store: names below a prefix, and an object's bytes."""

    def list(self, prefix: str) -> list[str]: ...

    def get(self, key: str) -> bytes: ...


def patient(call: Callable, *args, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep):
    """The call's result; a busy or failing service is asked again, after 1, 2, 4, .. seconds or as long as
    it says itself."""
    last: Exception | None = None
    for n in range(tries):
        try:
            return call(*args)
        except Busy as e:
            last, wait = e, e.seconds
        except OSError as e:
            last, wait = e, float(2**n)
        if n + 1 < tries:
            sleep(wait)
    raise RuntimeError(f"no answer after {tries} tries: {last!r}")


class Page(InputPartition):
    def __init__(self, start: int, size: int):
        super().__init__(start)
        self.start, self.size = start, size


def pages(service: Search, sleep: Callable[[float], None] = time.sleep) -> type[DataSource]:
    """A data source over ``service`` with options query, cap and page_size: (place, id), a partition a page."""

    class PagedSearch(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_search"

        def schema(self) -> str:
            return "place long, id string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.token, self.want, self.size = options["token"], int(options["want"]), int(options["page_size"])

        def partitions(self) -> list[InputPartition]:
            return [Page(s, min(self.size, self.want - s)) for s in range(0, self.want, self.size)] or [Page(0, 0)]

        def read(self, partition: Page) -> Iterator[tuple[int, str]]:
            at, end = partition.start, partition.start + partition.size
            while at < end:  # a service may give less than was asked for
                ids = patient(service.page, self.token, at, end - at, sleep=sleep)
                if not ids:
                    break
                for i in ids[: end - at]:
                    yield at, i
                    at += 1

    return PagedSearch


class Recorded:
    """Pages that were recorded, as a service that needs no network: a folder of text files, one a page, at any
    address that pyarrow's file systems know."""

    def __init__(self, folder: str, total: int, page_size: int):
        self.folder, self.of, self.size = folder, total, page_size

    def total(self, query: str) -> tuple[int, str]:
        return self.of, query

    def page(self, token: str, start: int, size: int) -> list[str]:
        import pyarrow.fs as fs

        at = start - start % self.size
        files, path = fs.FileSystem.from_uri(f"{self.folder}/start={at}")
        found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
        lines: list[str] = []
        for f in sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", "."))):
            with files.open_input_stream(f) as stream:
                lines += stream.read().decode("utf-8").splitlines()
        return lines[start - at : start - at + size]


def recorded(ids: DataFrame, folder: str, page_size: int) -> Recorded:
    """Writes (place, id), places from 0 without gaps, as pages."""
    start = F.col("place") - F.col("place") % page_size
    dealt = ids.select(start.alias("start"), "place", "id").repartition("start").sortWithinPartitions("start", "place")
    dealt.select("start", "id").write.partitionBy("start").text(folder)
    top = ids.agg(F.max("place")).first()[0]
    return Recorded(folder, 0 if top is None else top + 1, page_size)


@dataclass
class Found:
    """ids: (place, id) in the service's order; total: what it has; truncated: more than was fetched, so that
    the ids are the first in that order and no sample of all."""

    ids: DataFrame
    total: int
    truncated: bool


def search(spark: SparkSession, service: Search, query: str, cap: int, page_size: int = PAGE, sleep: Callable[[float], None] = time.sleep) -> Found:
    """What ``service`` finds for ``query``, up to ``cap`` ids; only the total reaches the driver."""
    if page_size < 1 or cap < 0:
        raise ValueError("page_size must be positive and cap must not be negative")
    ship(spark)
    total, token = patient(service.total, query, sleep=sleep)
    source = pages(service, sleep)
    spark.dataSource.register(source)
    ids = spark.read.format(source.name()).option("token", token).option("want", min(cap, total)).option("page_size", page_size).load()
    return Found(ids, total, total > cap)


def metadata(ids: DataFrame, summaries: Callable[[list[str]], dict[str, dict]], batch: int = BATCH) -> DataFrame:
    """(pmcid, title, journal, pubdate) of articles (pmcid), asked for in batches; a batch that fails gives
    no rows, since nothing depends on them."""
    ship(ids.sparkSession)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names, out = frame["pmcid"].tolist(), []
            for k in range(0, len(names), batch):
                try:
                    said = summaries(names[k : k + batch])
                    out += [(n, *[str(said[n].get(c, "")) for c in ("title", "journal", "pubdate")]) for n in names[k : k + batch] if n in said]
                except Exception:  # noqa: BLE001,S112  best effort
                    continue
            yield pd.DataFrame(out, columns=["pmcid", "title", "journal", "pubdate"], dtype=object)

    return ids.select(F.col("pmcid").cast("string")).mapInPandas(ask, "pmcid string, title string, journal string, pubdate string")


RESULT = "pmcid string, version int, status string, note string, license_code string, is_open_access boolean, xml_bytes long, sha256 string"


def fetched(store: Store, pmcid: str, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """One article's latest version: the columns of RESULT and its content (null unless ok)."""
    none = ("", None, 0, "", None)
    try:
        tails = [p.rstrip("/").rsplit(".", 1) for p in patient(store.list, f"{pmcid}.", sleep=sleep)]
    except Exception as e:  # noqa: BLE001  a failed article doesn't fail the fetch
        return (pmcid, None, "error", f"listing failed: {e}", *none)
    versions = [int(t[1]) for t in tails if len(t) == 2 and t[0] == pmcid and t[1].isdigit()]
    if not versions:
        return (pmcid, None, "skipped", "not in the store", *none)
    version = max(versions)
    key = f"{pmcid}.{version}/{pmcid}.{version}"
    try:
        meta = json.loads(patient(store.get, f"{key}.json", sleep=sleep))
    except Exception as e:  # noqa: BLE001
        return (pmcid, version, "error", f"metadata failed: {e}", *none)
    open_, code = bool(meta.get("is_pmc_openaccess", meta.get("is_open_access", True))), str(meta.get("license_code", meta.get("license", "")))
    if not open_:
        return (pmcid, version, "skipped", "not open access", code, False, 0, "", None)
    try:
        data = patient(store.get, f"{key}.xml", sleep=sleep)
    except Exception as e:  # noqa: BLE001
        return (pmcid, version, "error", f"text failed: {e}", *none)
    try:
        ET.fromstring(data)  # noqa: S314  noted, not refused
        note = ""
    except ET.ParseError as e:
        note = f"warning: not well-formed ({e})"
    return (pmcid, version, "ok", note, code, True, len(data), hashlib.sha256(data).hexdigest(), data)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Corpus:
    """Fetched articles in ``folder``: ``objects`` (pmcid, version, sha256, content), ``manifests`` one a
    fetch, each committed after its objects. The last manifest is the corpus."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def manifest(self) -> DataFrame:
        """RESULT of every article ever fetched, the newest of each."""
        rows = _table(self.spark, f"{self.folder}/manifests", f"{RESULT}, fetch long")
        newest = rows.groupBy("pmcid").agg(F.max("fetch").alias("fetch"))
        return rows.join(newest, ["pmcid", "fetch"]).drop("fetch")

    def objects(self) -> DataFrame:
        """(pmcid, version, content) of what the manifest has as ok: an object without such a row, of a fetch
        that died, doesn't count."""
        have = _table(self.spark, f"{self.folder}/objects", "pmcid string, version int, sha256 string, content binary")
        return have.join(self.manifest().where("status = 'ok'").select("pmcid", "version", "sha256"), ["pmcid", "version", "sha256"]).dropDuplicates(["pmcid"]).select("pmcid", "version", "content")

    def fetch(self, ids: DataFrame, store: Store, parallel: int = 8, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
        """Fetches articles (pmcid); returns this fetch's RESULT rows. What is there already and has the
        digest of its manifest row isn't asked for again (note ``resumed``); an object of another digest is an
        error, to be looked at. Articles that aren't in ``ids`` stay as they are."""
        ship(self.spark)
        wanted = ids.select(F.col("pmcid").cast("string")).where("pmcid is not null").distinct()
        before = self.manifest().where("status = 'ok'")
        have = _table(self.spark, f"{self.folder}/objects", "pmcid string, version int, sha256 string, content binary")
        actual = have.select("pmcid", "version", F.sha2("content", 256).alias("actual"))
        known = before.join(actual, ["pmcid", "version"]).groupBy("pmcid").agg(F.bool_or(F.col("actual") == F.col("sha256")).alias("fine"))
        old = before.join(known, "pmcid").join(wanted, "pmcid", "left_semi")
        names = [c.split(" ")[0] for c in RESULT.split(", ")]
        kept = old.withColumn("note", F.when(F.col("fine"), "resumed").otherwise("the object there has another digest"))
        kept = kept.withColumn("status", F.when(F.col("fine"), "ok").otherwise("error")).select(names)
        need = wanted.join(known.select("pmcid"), "pmcid", "left_anti").repartition(parallel, "pmcid")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for k in range(0, len(frame), 16):  # a few contents in memory at once
                    yield pd.DataFrame([fetched(store, i, sleep) for i in frame["pmcid"].iloc[k : k + 16]], columns=[*names, "content"], dtype=object)

        stage = f"{self.folder}/fetching/{uuid.uuid4().hex}"
        need.mapInPandas(run, f"{RESULT}, content binary").write.parquet(stage)
        new = self.spark.read.parquet(stage)
        new.where("status = 'ok'").select("pmcid", "version", "sha256", "content").write.mode("append").parquet(f"{self.folder}/objects")
        number = time.time_ns()
        rows = new.select(names).unionByName(kept).withColumn("fetch", F.lit(number))
        rows.write.mode("append").parquet(f"{self.folder}/manifests")
        return self.spark.read.parquet(f"{self.folder}/manifests").where(F.col("fetch") == number).select(names)
