"""Chunks: paragraphs merged by structure, single paragraphs, or whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TARGET, LEAST = 350, 5
PART = "struct<ord:int,title:string,text:string,char_start:int,char_end:int,n:int>"


def structural(paragraphs: DataFrame, target: int = TARGET, least: int = LEAST) -> DataFrame:
    """(pmcid, section, run, text, source_spans): paragraphs of one title merged while they stay within
    ``target`` tokens. Boilerplate titles end a run and are dropped; a longer paragraph stands alone;
    chunks under ``least`` tokens are dropped. The fold runs over one section's sorted paragraphs."""
    n = F.size(T.tokens(F.col("text"))).cast("int")
    part = F.struct(F.col("ord").cast("int").alias("ord"), "title", "text", "char_start", "char_end", n.alias("n"))
    grouped = paragraphs.groupBy("pmcid", "section").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    start = F.struct(F.lit(-1).alias("run"), F.lit(0).alias("held"), F.lit(0).alias("tokens"), F.lit(None).cast("string").alias("title"), F.array().cast("array<int>").alias("runs"))

    def step(acc: Column, p: Column) -> Column:
        # a run is open if it holds a paragraph, even one without tokens
        fresh = (acc["held"] == 0) | ~p["title"].eqNullSafe(acc["title"]) | (acc["tokens"] + p["n"] > target)
        skip = T.is_boilerplate(p["title"])
        run = acc["run"] + F.when(fresh, 1).otherwise(0)
        return F.when(skip, F.struct(acc["run"].alias("run"), F.lit(0).alias("held"), F.lit(0).alias("tokens"), F.lit(None).cast("string").alias("title"), F.concat(acc["runs"], F.array(F.lit(None).cast("int"))).alias("runs"))).otherwise(
            F.struct(run.alias("run"), F.when(fresh, F.lit(1)).otherwise(acc["held"] + 1).alias("held"), F.when(fresh, p["n"]).otherwise(acc["tokens"] + p["n"]).alias("tokens"), p["title"].alias("title"), F.concat(acc["runs"], F.array(run)).alias("runs"))
        )

    runs = F.aggregate("parts", start, step, lambda acc: acc["runs"])
    rows = grouped.withColumn("runs", runs).select("pmcid", "section", F.explode(F.arrays_zip("parts", "runs")).alias("z")).where(F.col("z.runs").isNotNull())
    return assemble(rows.select("pmcid", "section", F.col("z.runs").alias("run"), "z.parts.ord", "z.parts.text", "z.parts.char_start", "z.parts.char_end"), least)


def assemble(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """One chunk for each (pmcid, section, run); its tokens are counted on the merged text."""
    ordered = F.sort_array(F.collect_list(F.struct("ord", "text", "char_start", "char_end")))
    out = rows.groupBy("pmcid", "section", "run").agg(ordered.alias("p"))
    spans = F.transform("p", lambda x: F.struct(F.col("section").alias("section"), x["char_start"].alias("char_start"), x["char_end"].alias("char_end")))
    out = out.select("pmcid", "section", "run", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), spans.alias("source_spans"))
    out = out.where(F.size(T.tokens(F.col("text"))) >= least)
    name = F.concat_ws(":", F.col("pmcid").cast("string"), "section", F.concat_ws("-", F.get("source_spans", F.lit(0))["char_start"].cast("string"), F.element_at("source_spans", -1)["char_end"].cast("string")))
    return out.withColumn("chunk_id", name)


def paragraphs_as_chunks(paragraphs: DataFrame, least: int = LEAST) -> DataFrame:
    return assemble(paragraphs.select("pmcid", "section", F.col("ord").alias("run"), "ord", "text", "char_start", "char_end"), least)


def documents_as_chunks(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    span = F.array(F.struct(F.lit("doc").alias("section"), F.lit(0).alias("char_start"), F.length(text_col).alias("char_end")))
    return docs.select(F.col(id_col).alias("chunk_ord"), F.col(id_col).cast("string").alias("chunk_id"), F.col(text_col).alias("text"), span.alias("source_spans"))
