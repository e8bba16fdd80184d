"""Registry of queries, and the tables' roles.

An article is a document; its paragraphs are the lines of its text, in the section named by its
language, under titles that change every three lines; queries are the benchmark's items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TITLES = ("Introduction", "Materials and methods", "Results", "Discussion", "Acknowledgements", "Data availability")


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its DuckDB twin."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmcid, section, source, ord, title, text)."""
    d = table(spark, sf_dir, "documents")
    p = d.select(F.col("doc_id").alias("pmcid"), F.col("lang").alias("section"), "source", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return p.withColumn("title", F.get(F.array(*map(F.lit, TITLES)), ((F.floor(F.col("ord") / 3) + F.col("pmcid")) % len(TITLES)).cast("int")))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.with_offsets(raw_paragraphs(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_ord"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# --- the same roles in DuckDB SQL ---
def toks(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '[A-Za-z0-9][A-Za-z0-9.\\-]*'), lambda t: lower(t))"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\n\\r\\f\\x{{0B}}\\x{{00A0}}\\x{{2009}}\\x{{202F}}]+', ' ', 'g'))"


_titles = "[" + ", ".join(f"'{t}'" for t in TITLES) + "]"
PARA = f"""para AS (
  SELECT pmcid, section, source, ord, text, {_titles}[((ord // 3 + pmcid) % {len(TITLES)}) + 1] AS title,
    coalesce(sum(length(text) + 1) OVER (PARTITION BY pmcid, section ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS char_start
  FROM (SELECT doc_id AS pmcid, lang AS section, source, unnest(range(len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS text FROM documents)),
paragraph AS (SELECT *, (char_start + length(text))::INTEGER AS char_end FROM para)"""


def bm25(chunks: str, queries: str, k1: str = "1.5", b: str = "0.75", grid: str = "") -> str:
    """CTEs up to scored(query_id, chunk_ord, score); chunks: SELECT chunk_ord, text; queries: SELECT query_id, query."""
    more = f", {grid}" if grid else ""
    keys = "k1, b, " if grid else ""
    return f"""c AS (SELECT chunk_ord, {toks("text")} AS w FROM ({chunks})),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({toks("query")}) AS term FROM ({queries})) GROUP BY ALL),
corpus AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM c),
posting AS (SELECT chunk_ord, dl, term, count(*) AS tf FROM (SELECT chunk_ord, len(w) AS dl, unnest(w) AS term FROM c) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
scored AS (
  SELECT {keys}query_id, chunk_ord, round(sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score
  FROM q JOIN terms USING (term) JOIN posting USING (term), corpus{more} GROUP BY ALL)"""


DOCS = "SELECT doc_id AS chunk_ord, text FROM documents"
ITEMS = "SELECT item_id AS query_id, text AS query FROM benchmark"


def topk(k: int, by: str = "query_id") -> str:
    return f"run AS (SELECT *, rank FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, chunk_ord) AS rank FROM scored) WHERE rank <= {k})"


def wilson(s: str, n: str) -> tuple[str, str]:
    p, nn = f"({s} / {n}::DOUBLE)", f"{n}::DOUBLE"
    mid = f"(({p} + 3.8416 / (2 * {nn})) / (1 + 3.8416 / {nn}))"
    half = f"(1.96 * sqrt({p} * (1 - {p}) / {nn} + 3.8416 / (4 * {nn} * {nn})) / (1 + 3.8416 / {nn}))"
    return f"coalesce(CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(0.0, {mid} - {half}) END, 0.0)", f"coalesce(CASE WHEN {n} = 0 THEN 0.0 ELSE least(1.0, {mid} + {half}) END, 0.0)"
