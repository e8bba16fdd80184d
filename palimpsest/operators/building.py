"""Building a set of cases to quotas, batch by batch, so that a killed build goes on where it stopped.

The pool is drawn once: of each article one candidate a stratum, of each stratum the first so many by a
hash. It is streamed in batches; each batch tries the candidates of strata that are still short, writes
what it made under its own number and then what of it counts. A batch that is run again replaces itself,
counters are read from the batches before it, and the stream's checkpoint knows which one is next. A
failed call costs its candidate, not the run. When all quotas are met the stream stops.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship
from .sampling import first_per, shuffle_key

#: Candidates drawn for each place in the quota, and candidates of a stratum that one batch tries for each
#: place, at least.
OVERSAMPLE, STEP = 3.0, 0.5


def pool(candidates: DataFrame, key: str, stratum: str, article: str, depth: int, seed: int = 0) -> DataFrame:
    """``candidates`` with ``place``: one of each article and stratum, of each stratum the first ``depth``
    by a hash of the key. A stratum is first cut to ``depth`` rows in many parts, so none is one task."""
    order = [shuffle_key(key, seed), key]
    one = first_per(candidates, [article, stratum], order)
    few = first_per(one.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(64))), [stratum, "_part"], order, depth).drop("_part")
    return few.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("place") <= depth)


def attempting(generate: Callable[[dict], dict], fields: list[str], made: str) -> Callable[[DataFrame], DataFrame]:
    """A step that adds the columns ``made`` (a schema), which ``generate`` makes of a row's ``fields``, and
    ``failed``: null, or why the call gave nothing."""
    names = [c.strip().split(" ")[0] for c in made.split(",")]

    def step(rows: DataFrame) -> DataFrame:
        ship(rows.sparkSession)
        schema = StructType([*rows.schema.fields, *StructType.fromDDL(made).fields, *StructType.fromDDL("failed string").fields])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out: dict[str, list] = {c: [] for c in [*names, "failed"]}
                for row in frame[fields].to_dict("records"):
                    try:
                        said, failed = generate(row), None
                        if not isinstance(said, dict):
                            said, failed = {}, "call_failed:not_an_object"
                    except Exception as e:  # noqa: BLE001  a dead call costs one candidate
                        said, failed = {}, f"call_failed:{type(e).__name__}"
                    for c in names:
                        out[c].append(said.get(c))
                    out["failed"].append(failed)
                yield frame.assign(**{c: pd.Series(v, index=frame.index, dtype=object) for c, v in out.items()})

        return rows.mapInPandas(run, schema)

    return step


def _read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None  # nothing there yet


class Build:
    """A build in ``folder``, a place that all machines share.

    attempt: rows -> the same rows with whatever it makes, and ``reason``: null for a case that counts.
    ``run`` may be called again after a crash, or with a larger pool in another folder; it returns itself.
    """

    def __init__(self, spark: SparkSession, folder: str, quota: int, key: str, stratum: str, article: str, oversample: float = OVERSAMPLE, seed: int = 0):
        self.spark, self.folder, self.quota = spark, folder.rstrip("/"), quota
        self.key, self.stratum, self.article = key, stratum, article
        self.depth, self.step, self.seed = max(1, int(quota * oversample)), max(1, int(quota * STEP)), seed

    def _draw(self, candidates: DataFrame) -> StructType:
        """Writes the pool, a file a batch in their order; a pool that is complete stays as it is."""
        there = _read(self.spark, f"{self.folder}/drawn")
        if there is None:
            drawn = pool(candidates, self.key, self.stratum, self.article, self.depth, self.seed)
            drawn = drawn.withColumn("batch", F.floor((F.col("place") - 1) / self.step).cast("int"))
            drawn.write.mode("overwrite").parquet(f"{self.folder}/drawn")
            there = _read(self.spark, f"{self.folder}/drawn")
        schema = there.schema
        have = _read(self.spark, f"{self.folder}/pool", schema)
        done = have.agg(F.max("batch")).first()[0] if have is not None else None
        last = there.agg(F.max("batch")).first()[0]
        for b in range(0 if done is None else done + 1, 0 if last is None else last + 1):
            there.where(F.col("batch") == b).coalesce(1).write.mode("append").parquet(f"{self.folder}/pool")
        return schema

    def counts(self, before: int | None = None) -> dict:
        """Accepted cases of each stratum, of the batches before one."""
        rows = self.accepted()
        if rows is None:
            return {}
        rows = rows if before is None else rows.where(F.col("run") < before)
        return {r[self.stratum]: r["count"] for r in rows.groupBy(self.stratum).count().collect()}

    def accepted(self) -> DataFrame | None:
        return _read(self.spark, f"{self.folder}/accepted")

    def rejected(self) -> DataFrame | None:
        """Tried candidates that don't count, with the reason."""
        return _read(self.spark, f"{self.folder}/rejected")

    def _batch(self, attempt: Callable[[DataFrame], DataFrame], full: threading.Event) -> Callable[[DataFrame, int], None]:
        def run(rows: DataFrame, number: int) -> None:
            have = self.counts(before=number)
            closed = [s for s, n in have.items() if n >= self.quota]
            todo = rows if not closed else rows.where(~F.coalesce(F.col(self.stratum).isin(closed), F.lit(False)))
            if todo.isEmpty():
                full.set()  # a batch holds all strata that have candidates left
                return
            made = f"{self.folder}/tried/run={number}"
            attempt(todo).write.mode("overwrite").parquet(made)
            tried = self.spark.read.parquet(made)
            left = F.lit(self.quota).cast("long")
            for s, n in have.items():
                left = F.when(F.col(self.stratum).eqNullSafe(F.lit(s)), F.lit(self.quota - n).cast("long")).otherwise(left)
            nth = F.row_number().over(Window.partitionBy(self.stratum, F.col("reason").isNull()).orderBy("place"))
            ranked = tried.withColumn("_n", nth).withColumn("_left", left)
            fits = F.col("reason").isNull() & (F.col("_n") <= F.col("_left"))
            ranked.where(fits).drop("_n", "_left", "reason").write.mode("overwrite").parquet(f"{self.folder}/accepted/run={number}")
            over = ranked.where(~fits).withColumn("reason", F.coalesce("reason", F.lit("quota_full"))).drop("_n", "_left")
            over.write.mode("overwrite").parquet(f"{self.folder}/rejected/run={number}")

        return run

    def run(self, candidates: DataFrame, attempt: Callable[[DataFrame], DataFrame]) -> Build:
        schema = self._draw(candidates)
        if _read(self.spark, f"{self.folder}/pool", schema) is None:  # no candidates
            return self
        full = threading.Event()
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/pool")
        query = stream.writeStream.foreachBatch(self._batch(attempt, full)).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        while not query.awaitTermination(1):
            if full.is_set():
                query.stop()
        return self

    def summary(self) -> DataFrame:
        """(stratum, accepted, tried, short) of all strata that had candidates."""
        drawn = _read(self.spark, f"{self.folder}/drawn").select(self.stratum).distinct()
        parts = [(self.accepted(), 1), (self.rejected(), 0)]
        rows = [d.select(F.col(self.stratum).alias("s"), F.lit(n).alias("ok")) for d, n in parts if d is not None]
        every = drawn.select(F.col(self.stratum).alias("s"), F.lit(None).cast("int").alias("ok"))
        for r in rows:
            every = every.unionByName(r)
        out = every.groupBy("s").agg(F.coalesce(F.sum("ok"), F.lit(0)).alias("accepted"), F.count("ok").alias("tried"))
        return out.select(F.col("s").alias(self.stratum), "accepted", "tried", F.greatest(F.lit(0).cast("long"), self.quota - F.col("accepted")).alias("short"))

    def reasons(self) -> DataFrame:
        """(reason, n): what precedes the first colon of why candidates were tried in vain."""
        rows = self.rejected()
        if rows is None:
            return self.spark.createDataFrame([], "reason string, n long")
        return rows.groupBy(F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))
