"""Files made from the given tables, written to the shared folder and read back by the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import labels, numbering, service
from ..sources import files, jats, remote
from .base import PARA, query, table

S, D = SparkSession, DataFrame


@query("SELECT o_orderkey::VARCHAR AS pmcid, 'title, \"' || o_custkey || '\"' AS title, o_orderkey % 9 AS xml_bytes FROM orders WHERE o_orderstatus <> 'P'")
def scan_manifest_ok(spark: S, sf: str) -> D:
    k, nothing = F.col("o_orderkey"), F.lit(None).cast("string")
    rows = table(spark, sf, "orders").select(k.cast("string").alias("pmcid"), F.lit(1).alias("version"), F.when(F.col("o_orderstatus") == "P", "skipped").otherwise("ok").alias("status"), nothing.alias("note"), nothing.alias("license_code"), F.lit("True").alias("is_open_access"), (k % 9).alias("xml_bytes"), nothing.alias("sha256"), F.concat(F.lit('title, "'), F.col("o_custkey").cast("string"), F.lit('"')).alias("title"), nothing.alias("journal"), nothing.alias("pubdate"), nothing.alias("retrieved_at_utc"))
    path = files.shared_folder(spark)
    files.write_csv(rows, path)
    return files.manifest(spark, path).select("pmcid", "title", "xml_bytes")


@query("SELECT 'p' || c_custkey AS pair_id, 1 + (c_custkey % 3 = 0)::INTEGER AS n_genes, c_mktsegment AS first_condition FROM customer")
def scan_term_sets(spark: S, sf: str) -> D:
    k = F.col("c_custkey").cast("string")
    genes = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" G"), k, F.lit(" ;; H"), k)).otherwise(F.concat(F.lit("G"), k))
    rows = table(spark, sf, "customer").select(F.concat(F.lit("p"), k).alias("pair_id"), genes.alias("genes"), F.lit("").alias("variants"), F.concat("c_mktsegment", F.lit("; ")).alias("conditions"))
    path = files.shared_folder(spark)
    files.write_csv(rows, path)
    t = files.term_sets(spark, path)
    return t.select("pair_id", F.size("genes").alias("n_genes"), F.get("conditions", F.lit(0)).alias("first_condition"))


@query("SELECT doc_id::VARCHAR AS id, md5(text) AS text_md5, source AS title FROM documents")
def beir_scan(spark: S, sf: str) -> D:
    """Every document twice in one JSON lines file, the first time with another text; the last counts."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("title"))
    both = d.select("id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("old").alias("text")), F.struct(F.lit(1).alias("k"), F.col("text").alias("text")))).alias("v"), "title")
    path = files.shared_folder(spark)
    both.select(F.to_json(F.struct("id", "v.text", "title")).alias("value")).write.text(path)
    return files.beir(spark, path, files.BEIR_CORPUS).select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "title")


@query("SELECT (l_orderkey % 500)::VARCHAR AS query_id, l_partkey::VARCHAR AS doc_id, (l_linenumber % 3)::INTEGER AS rel FROM lineitem WHERE l_suppkey % 7 > 0")
def qrels_scan(spark: S, sf: str) -> D:
    li = table(spark, sf, "lineitem")
    line = F.when(F.col("l_suppkey") % 7 == 0, F.lit("too few")).otherwise(F.concat_ws(" \t", (F.col("l_orderkey") % 500).cast("string"), F.lit("0"), F.col("l_partkey").cast("string"), (F.col("l_linenumber") % 3).cast("string")))
    path = files.shared_folder(spark)
    li.select(line.alias("value")).write.text(path)
    return files.qrels(spark, path)


@query("SELECT l_orderkey % 500 AS query_id, count(DISTINCT l_partkey) AS n_relevant, sum((l_linenumber % 3)::INTEGER)::BIGINT AS total FROM lineitem WHERE l_linenumber % 3 > 0 GROUP BY 1")
def beir_relevant_docs(spark: S, sf: str) -> D:
    q = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("query_id"), F.col("l_partkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("rel")).where("rel > 0")
    return q.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_relevant"), F.sum("rel").cast("long").alias("total"))


@query("SELECT doc_id AS pmcid, sha256(text) AS actual FROM documents WHERE doc_id % 10 = 0")
def source_hash_check(spark: S, sf: str) -> D:
    d = table(spark, sf, "documents")
    listed = d.select(F.col("doc_id").alias("pmcid"), F.when(F.col("doc_id") % 20 == 0, F.lit("00")).otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("sha256")).where("pmcid % 20 <> 10")
    return files.hash_mismatches(d.select(F.col("doc_id").alias("pmcid"), F.col("text").cast("binary").alias("content")), listed).select("pmcid", "actual")


@query("SELECT 'A' || l_partkey AS pmcid, max(l_suppkey)::INTEGER AS version FROM lineitem WHERE l_linenumber < 6 GROUP BY 1")
def latest_version(spark: S, sf: str) -> D:
    suffix = F.when(F.col("l_linenumber") < 6, F.col("l_suppkey").cast("string")).otherwise("draft")
    return files.latest_versions(table(spark, sf, "lineitem").select(F.concat(F.lit("A"), F.col("l_partkey").cast("string"), F.lit("."), suffix, F.lit("/")).alias("prefix")))


@query("""WITH s AS (SELECT user_id, event_id, value, event_type, CASE WHEN event_id % 5 > 0 THEN event_id - event_id % 5 END AS parent FROM events), k AS (SELECT parent, sum(value) AS inner_ms FROM s WHERE parent IS NOT NULL GROUP BY 1)
SELECT event_type AS name, count(*) AS n, round(sum(value), 4) AS total_ms, round(sum(value - coalesce(inner_ms, 0)), 4) AS self_ms FROM s LEFT JOIN k ON k.parent = event_id GROUP BY 1""")
def trace_self_time(spark: S, sf: str) -> D:
    parent = F.when(F.col("event_id") % 5 > 0, F.col("event_id") - F.col("event_id") % 5)
    out = service.self_times(table(spark, sf, "events").select(F.col("event_id").alias("span_id"), parent.alias("parent"), F.col("event_type").alias("name"), F.col("value").alias("ms")))
    return out.withColumns({c: F.round(c, 4) for c in ("total_ms", "self_ms")})


@query("""WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS place, 'PMC' || c_custkey AS id, count(*) OVER () AS total FROM customer) SELECT place, id, total, total > 1000 AS truncated FROM c WHERE place < 1000""")
def paged_search(spark: S, sf: str) -> D:
    """All customers as recorded pages of 300, read back page by page up to a cap of 1,000."""
    c = table(spark, sf, "customer").select("c_custkey")
    ids = numbering.numbered(c, "c_custkey").select((F.col("n") - 1).alias("place"), F.concat(F.lit("PMC"), F.col("c_custkey").cast("string")).alias("id"))
    folder = files.shared_folder(spark)
    service_ = remote.recorded(ids, folder if ":" in folder else f"file://{folder}", 300)
    found = remote.search(spark, service_, "customers", 1000, 170)
    return found.ids.withColumn("total", F.lit(found.total).cast("long")).withColumn("truncated", F.lit(found.truncated))


def escaped(c):
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def articles(spark: S, sf: str) -> D:
    """Each document as article XML: its first line as abstract, the others as paragraphs of nested
    sections, with a citation at the end of each."""
    lines = F.split(escaped(F.col("text")), "\n")
    cite = F.lit(' [<xref ref-type="bibr">1</xref>, <xref ref-type="bibr">2</xref>].')
    body = F.array_join(F.transform(F.slice(lines, 2, 1_000_000_000), lambda x, i: F.concat(F.when(i % 3 == 0, F.lit("<sec><title> </title><p>")).otherwise(F.lit("<sec><title>In  <i>depth</i></title><p>")), x, cite, F.lit("</p></sec>"))), "")
    xml = F.concat(F.lit("<article><front><abstract><p>"), F.get(lines, F.lit(0)), F.lit("</p></abstract></front><body><sec><title>Main</title>"), body, F.lit("</sec></body>"), F.when(F.col("doc_id") % 50 == 7, F.lit("<broken")).otherwise(F.lit("</article>")))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("pmcid"), xml.alias("xml"))


_lines = """line AS (SELECT doc_id AS pmcid, i, t FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS t FROM documents WHERE doc_id % 50 <> 7)),
p AS (SELECT pmcid, 'abstract' AS section, 0 AS ord, NULL AS title, t AS text FROM line WHERE i = 0 UNION ALL SELECT pmcid, 'body', i - 1, CASE WHEN (i - 1) % 3 = 0 THEN 'Main' ELSE 'In depth' END, t || ' [1, 2].' FROM line WHERE i > 0
  UNION ALL SELECT pmcid, 'body', 0, NULL, 'Main' FROM line GROUP BY pmcid HAVING count(*) = 1)"""


@query(f"WITH {_lines} SELECT pmcid, section, ord::INTEGER AS ord, md5(text) AS text_md5, coalesce(sum(length(text) + 1) OVER (PARTITION BY pmcid, section ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS char_start FROM p")
def xml_paragraphs(spark: S, sf: str) -> D:
    return jats.paragraphs(articles(spark, sf)).select("pmcid", "section", "ord", F.md5(F.col("text").cast("binary")).alias("text_md5"), "char_start")


@query(f"WITH {_lines} SELECT pmcid, section, ord::INTEGER AS ord, title FROM p")
def section_titles(spark: S, sf: str) -> D:
    return jats.paragraphs(articles(spark, sf)).select("pmcid", "section", "ord", "title")
