"""Inverted index as tables, and batched BM25 search over them.

Queries are a table: one job answers all of them. Postings are only made or read for terms that some
query holds; chunks are scored where they lie, and only the best of each task travel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as T
from ..session import ship
from .tables import kept

K1, B = 1.5, 0.75
#: Scores are rounded before they rank, so that sums in another order rank alike.
DIGITS = 6
#: Terms of all queries together that are sent to the chunks, and scores that a task holds at once.
MOST_QUERY_TERMS, CELLS = 200_000, 1 << 22


@dataclass
class Index:
    """lengths (chunk_ord, dl), postings (term, chunk_ord, tf, dl), terms (term, df), corpus (n_docs, avgdl)."""

    lengths: DataFrame
    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame

    TABLES = ("lengths", "postings", "terms", "corpus")

    def save(self, path: str) -> None:
        """Parquet tables; an existing index is never overwritten. Texts are tokenised once, for the
        postings, which lie sorted by term; the other tables follow from what was written."""
        spark = self.postings.sparkSession
        self.postings.sortWithinPartitions("term", "chunk_ord").write.mode("errorifexists").parquet(f"{path}/postings")
        postings = spark.read.parquet(f"{path}/postings")
        document_frequencies(postings).write.mode("errorifexists").parquet(f"{path}/terms")
        # chunks without any token have no posting
        held = postings.groupBy("chunk_ord").agg(F.first("dl").alias("dl"))
        lengths = self.lengths.select("chunk_ord").join(held, "chunk_ord", "left").select("chunk_ord", F.coalesce("dl", F.lit(0)).alias("dl"))
        lengths.write.mode("errorifexists").parquet(f"{path}/lengths")
        corpus_of(spark.read.parquet(f"{path}/lengths")).write.mode("errorifexists").parquet(f"{path}/corpus")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in cls.TABLES))


def tokenized(chunks: DataFrame) -> DataFrame:
    """(chunk_ord, dl, tokens)"""
    t = chunks.select("chunk_ord", T.tokens(F.col("text")).alias("tokens"))
    return t.select("chunk_ord", F.size("tokens").cast("long").alias("dl"), "tokens")


def frequencies(t: DataFrame) -> DataFrame:
    """(term, chunk_ord, tf, dl): a posting carries its chunk's length, so that scoring needs no join."""
    return t.select("chunk_ord", "dl", F.explode("tokens").alias("term")).groupBy("term", "chunk_ord").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_of(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def build(chunks: DataFrame) -> Index:
    """Index of chunks (chunk_ord, text)."""
    t = tokenized(chunks)
    lengths, postings = t.select("chunk_ord", "dl"), frequencies(t)
    return Index(lengths, postings, document_frequencies(postings), corpus_of(lengths))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, query) -> (query_id, term, qtf)."""
    return queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def scores(index: Index, queries: DataFrame, k1: Column | float = K1, b: Column | float = B, grid: DataFrame | None = None) -> DataFrame:
    """(grid columns, query_id, chunk_ord, score) of every chunk that shares a term with a query."""
    return _score(query_terms(queries), index.postings, index.terms, index.corpus, k1, b, grid)


def _score(q: DataFrame, postings: DataFrame, terms: DataFrame, corpus: DataFrame, k1: Column | float, b: Column | float, grid: DataFrame | None = None) -> DataFrame:
    # what belongs to a query's term is computed once for it, before it meets the postings
    q = q.join(terms, "term").join(corpus).select("query_id", "term", "avgdl", (F.col("qtf") * idf(F.col("n_docs"), F.col("df"))).alias("w"))
    hits, keys = postings.join(q, "term"), ["query_id", "chunk_ord"]
    if grid is not None:
        hits, keys = hits.join(grid), [*grid.columns, *keys]
        k1, b = F.col("k1"), F.col("b")
    k1, b = (F.lit(x) if isinstance(x, float) else x for x in (k1, b))
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy(*keys).agg(F.round(F.sum(part), DIGITS).alias("score"))


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds rank from 1 and keeps k a query; ties go to the smaller chunk_ord."""
    if k < 1:
        raise ValueError("k must be positive")
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("chunk_ord"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """The first k chunks of each query: (query_id, chunk_ord, score, rank)."""
    return _ranked(query_terms(queries), index.postings, index.terms, index.corpus, k, k1, b)


def search_texts(chunks: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, grid: DataFrame | None = None) -> DataFrame:
    """Search without a stored index: one pass makes postings of the queries' terms only. With a grid of
    settings (k1, b and columns that name them) each of them ranks for itself: (grid columns, query_id,
    chunk_ord, score, rank)."""
    q, t = query_terms(queries), tokenized(chunks)
    wanted = q.select("term").distinct()
    held = t.select("chunk_ord", "dl", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    postings = kept(held.groupBy("term", "chunk_ord").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")), "postings")
    return _ranked(q, postings, document_frequencies(postings), corpus_of(t.select("dl")), k, k1, b, grid)


def _ranked(q: DataFrame, postings: DataFrame, terms: DataFrame, corpus: DataFrame, k: int, k1: float, b: float, grid: DataFrame | None = None) -> DataFrame:
    """Queries of a bounded number of terms are sent to where the chunks are: the postings of their terms are
    dealt by chunk, each task scores its chunks for all queries and settings in arrays and keeps the first k
    of each, and these few meet. Beyond that bound, queries and postings meet in a join."""
    if k < 1:
        raise ValueError("k must be positive")
    grid = grid.distinct() if grid is not None else None
    settings = grid.limit(MOST_QUERY_TERMS + 1).collect() if grid is not None else []
    weighed = q.join(terms, "term").join(corpus).select("query_id", "term", "avgdl", (F.col("qtf") * idf(F.col("n_docs"), F.col("df"))).alias("w"))
    few = weighed.limit(MOST_QUERY_TERMS + 1).collect()
    if len(few) * max(1, len(settings)) > MOST_QUERY_TERMS:
        return top_k(_score(q, postings, terms, corpus, k1, b, grid), k, (*(grid.columns if grid is not None else ()), "query_id"))
    spark = postings.sparkSession
    ship(spark)
    names = {t: i for i, t in enumerate(sorted({r["term"] for r in few}))}
    ids = {i: n for n, i in enumerate(dict.fromkeys(r["query_id"] for r in few))}
    plan = Plan(list(ids), [], [], k, [(r["k1"], r["b"]) for r in settings] if grid is not None else [(k1, b)], few[0]["avgdl"] if few else 0.0, to_arrow_type(q.schema["query_id"].dataType))
    by_term: dict[int, list] = {}
    for r in few:
        by_term.setdefault(names[r["term"]], []).append((ids[r["query_id"]], r["w"]))
    for i in range(len(names)):
        plan.queries.append(np.array([n for n, _ in by_term[i]], np.int64))
        plan.weights.append(np.array([w for _, w in by_term[i]]))
    kind = q.schema["query_id"].dataType.simpleString()
    chunk = postings.schema["chunk_ord"].dataType.simpleString()
    numbers = spark.createDataFrame(list(names.items()), "term string, t int")  # bounded by MOST_QUERY_TERMS
    held = postings.join(F.broadcast(numbers), "term").select("t", F.col("chunk_ord").cast("long"), F.col("tf").cast("double"), F.col("dl").cast("double"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sent = spark.sparkContext.broadcast(plan)
    found = held.repartition(parts, "chunk_ord").mapInArrow(lambda it: scored_blocks(it, sent.value), f"setting int, query_id {kind}, chunk_ord long, score double")
    found = found.select("setting", "query_id", F.col("chunk_ord").cast(chunk), F.round("score", DIGITS).alias("score"))
    if grid is None:
        return top_k(found.drop("setting"), k)
    best = top_k(found, k, ("setting", "query_id"))
    numbered = spark.createDataFrame([(n, tuple(r)) for n, r in enumerate(settings)], StructType([StructField("setting", IntegerType()), StructField("g", grid.schema)]))  # bounded likewise
    return best.join(F.broadcast(numbered), "setting").select("g.*", "query_id", "chunk_ord", "score", "rank")


@dataclass
class Plan:
    """What a task needs to score its chunks: query ids, for each term its queries and their weights, and the
    settings (k1, b)."""

    ids: list
    queries: list
    weights: list
    k: int
    settings: list[tuple[float, float]]
    avgdl: float
    kind: pa.DataType


def scored_blocks(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """(t, chunk_ord, tf, dl), all postings of some chunks -> the best chunks of each setting and query among
    them: the first k, and all that might be among them once scores are rounded."""
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for batch in batches:
        for c, values in zip(columns, batch.columns, strict=True):
            c.append(values.to_numpy(zero_copy_only=False))
    if not columns[0] or not sum(map(len, columns[0])) or not plan.ids:
        return
    t, chunk, tf, dl = map(np.concatenate, columns)
    chunks, place = np.unique(chunk, return_inverse=True)
    order = np.argsort(t, kind="stable")
    t, place, tf, dl = t[order], place[order], tf[order], dl[order]
    edges = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    ends = np.append(edges[1:], len(t))
    at_once = max(1, CELLS // len(chunks))
    ids = pa.array(plan.ids, plan.kind)
    for setting, (k1, b) in enumerate(plan.settings):
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / plan.avgdl))
        for lo in range(0, len(plan.ids), at_once):
            scores = np.zeros((min(at_once, len(plan.ids) - lo), len(chunks)))
            for s, e in zip(edges, ends, strict=True):
                its, w = plan.queries[t[s]], plan.weights[t[s]]
                here = (its >= lo) & (its < lo + len(scores))
                if here.any():
                    scores[(its[here] - lo)[:, None], place[s:e]] += w[here][:, None] * part[s:e]
            rows, cols = [], []
            for n, row in enumerate(scores):
                least = np.partition(row, len(row) - plan.k)[len(row) - plan.k] if len(row) > plan.k else 0.0
                best = np.flatnonzero((row > 0) & (row >= least - 2 * 10.0**-DIGITS))
                rows.append(np.full(len(best), n))
                cols.append(best)
            r, c = np.concatenate(rows), np.concatenate(cols)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), setting, np.int32)), ids.take(pa.array(r + lo)), pa.array(chunks[c]), pa.array(scores[r, c])], names=["setting", "query_id", "chunk_ord", "score"])
