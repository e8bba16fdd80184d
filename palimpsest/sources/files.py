"""Readers of the engine's file formats: explicit schemas everywhere, nothing is inferred."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared

MANIFEST = "pmcid string, version int, status string, note string, license_code string, is_open_access string, xml_bytes long, sha256 string, title string, journal string, pubdate string, retrieved_at_utc string"
TERM_SETS = "pair_id string, genes string, variants string, conditions string"
BEIR_CORPUS = "id string, text string, title string"
BEIR_QUERIES = "id string, text string"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors can write to and read."""
    return f"{shared(spark)}/files-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """Rows of articles that were fetched; the filter is pushed to the reader."""
    return read_csv(spark, path, schema).where("status = 'ok'")


def split_terms(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ";"), F.trim), lambda t: t != "")


def term_sets(spark: SparkSession, path: str) -> DataFrame:
    t = read_csv(spark, path, TERM_SETS)
    return t.select("pair_id", *[split_terms(F.col(c)).alias(c) for c in ("genes", "variants", "conditions")])


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines give no row, malformed ones fail."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def beir(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents or queries; of repeated ids the last line counts. Line order is that of the files. Blank
    lines give no row, malformed ones fail."""
    t = spark.read.text(path).where(F.trim("value") != "").withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    t = t.select("_at", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("_at", "r.*")
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_at")))
    return t.withColumn("_n", last).where("_n = 1").drop("_n", "_at")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """TREC judgments: four fields at least, split at white space; other lines are skipped."""
    p = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where("size(p) >= 4")
    return p.select(F.get("p", F.lit(0)).alias("query_id"), F.get("p", F.lit(2)).alias("doc_id"), F.get("p", F.lit(3)).cast("int").alias("rel"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc.hadoopConfiguration()).exists(p)


@dataclass
class Dataset:
    """documents (id, text, title), queries (id, text) and judgments (query_id, doc_id, rel)."""

    documents: DataFrame
    queries: DataFrame
    judgments: DataFrame

    def relevant(self) -> DataFrame:
        """(query_id, doc_id, rel) of what is relevant at all."""
        return self.judgments.where("rel > 0")

    def texts(self) -> DataFrame:
        """(doc_id, text) as they are indexed: title, a space, body."""
        return self.documents.select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.nullif("title", F.lit("")), "text").alias("text"))


def dataset(spark: SparkSession, path: str) -> Dataset:
    """The three files of a benchmark in one folder; FileNotFoundError if any is missing."""
    names = ("corpus.jsonl", "queries.jsonl", "qrels.txt")
    missing = [n for n in names if not exists(spark, f"{path}/{n}")]
    if missing:
        raise FileNotFoundError(f"{path} lacks {', '.join(missing)}")
    corpus, asked, judged = (f"{path}/{n}" for n in names)
    return Dataset(beir(spark, corpus, BEIR_CORPUS), beir(spark, asked, BEIR_QUERIES), qrels(spark, judged))


def hash_mismatches(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files (pmcid, content) whose SHA-256 isn't the listed one, or that aren't listed."""
    actual = files.select("pmcid", F.sha2("content", 256).alias("actual"))
    return actual.join(listed.select("pmcid", "sha256"), "pmcid", "left").where(~F.col("actual").eqNullSafe(F.col("sha256")))


def latest_versions(prefixes: DataFrame) -> DataFrame:
    """(pmcid, version) from object prefixes like ``NAME.3/``; other prefixes don't count."""
    m = prefixes.select(F.regexp_extract("prefix", r"^([^.]+)\.([0-9]+)/?$", 1).alias("pmcid"), F.regexp_extract("prefix", r"^([^.]+)\.([0-9]+)/?$", 2).alias("v"))
    return m.where("pmcid <> ''").groupBy("pmcid").agg(F.max(F.col("v").cast("int")).alias("version"))
