"""Index, search, chunks and spans over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, index, serving, spans
from ..sources import files
from .base import DOCS, ITEMS, PARA, bm25, documents, paragraphs, query, questions, raw_paragraphs, table, toks, topk

S, D = SparkSession, DataFrame


@query(f"WITH {bm25(DOCS, ITEMS)}, {topk(10)} SELECT query_id, chunk_ord, score, rank::INTEGER AS rank FROM run")
def bm25_topk(spark: S, sf: str) -> D:
    return index.search_texts(documents(spark, sf), questions(spark, sf), 10)


@query(f"WITH g(k1, b) AS (VALUES (0.9::DOUBLE, 0.4::DOUBLE), (1.2, 0.75), (1.5, 0.75), (2.0, 0.9)), {bm25(DOCS, ITEMS, 'k1', 'b', 'g')}, {topk(5, 'k1, b, query_id')} SELECT k1, b, query_id, chunk_ord, score, rank::INTEGER AS rank FROM run")
def bm25_param_sweep(spark: S, sf: str) -> D:
    grid = spark.sql("SELECT * FROM VALUES (0.9D, 0.4D), (1.2D, 0.75D), (1.5D, 0.75D), (2.0D, 0.9D) AS g(k1, b)")
    return index.search_texts(documents(spark, sf), questions(spark, sf), 5, grid=grid)


@query(f"SELECT doc_id, len({toks('text')})::BIGINT AS n_tokens, md5(array_to_string({toks('text')}, ' ')) AS tokens_md5 FROM documents")
def tokenize(spark: S, sf: str) -> D:
    t = T.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("tokens_md5"))


@query(f"SELECT chunk_ord, term, count(*) AS tf FROM (SELECT doc_id AS chunk_ord, unnest({toks('text')}) AS term FROM documents) GROUP BY ALL")
def term_freq(spark: S, sf: str) -> D:
    return index.build(documents(spark, sf)).postings.select("chunk_ord", "term", "tf")


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) GROUP BY ALL")
def doc_freq(spark: S, sf: str) -> D:
    return index.build(documents(spark, sf)).terms


@query(f"SELECT count(*) AS n_docs, round(coalesce(avg(len({toks('text')})), 0), 6) AS avgdl FROM documents")
def corpus_stats(spark: S, sf: str) -> D:
    return index.build(documents(spark, sf)).corpus.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH t AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents) SELECT term, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM t, n")
def idf(spark: S, sf: str) -> D:
    i = index.build(documents(spark, sf))
    return i.terms.join(i.corpus).select("term", F.round(index.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query(f"WITH {bm25('SELECT doc_id AS chunk_ord, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)', ITEMS)}, {topk(10)} SELECT query_id, chunk_ord, score, rank::INTEGER AS rank FROM run")
def build_index_excluding(spark: S, sf: str) -> D:
    held_out = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_ord"))
    return index.search_texts(documents(spark, sf).join(held_out, "chunk_ord", "left_anti"), questions(spark, sf), 10)


_service = f"""WITH {bm25(DOCS, ITEMS)}, {topk(40)},
hit AS (SELECT query_id, chunk_ord AS pmcid, rank, score, count(*) OVER (PARTITION BY query_id) AS n FROM run)"""


@query(f"{_service} SELECT query_id, rank::INTEGER AS rank, pmcid, coalesce(source, pmcid::VARCHAR) AS title, length(text)::INTEGER AS char_end FROM hit LEFT JOIN documents ON doc_id = pmcid WHERE rank <= 5")
def service_search(spark: S, sf: str) -> D:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pmcid"), "source", F.length("text").alias("char_end"))
    hits = index.search_texts(documents(spark, sf), questions(spark, sf), 40).where("rank <= 5").withColumnRenamed("chunk_ord", "pmcid")
    return hits.join(d, "pmcid", "left").select("query_id", "rank", "pmcid", F.coalesce("source", F.col("pmcid").cast("string")).alias("title"), "char_end")


@query(f"""{_service} SELECT item_id AS query_id, coalesce(max(n), 0)::BIGINT AS candidates_scanned, least(coalesce(max(n), 0), 5)::BIGINT AS n_matches,
CASE WHEN len({toks("any_value(b.text)")}) = 0 THEN 'no_query_words' WHEN coalesce(max(n), 0) > 5 THEN 'max_matches' ELSE 'exhausted' END AS stopped_reason
FROM benchmark b LEFT JOIN hit ON query_id = item_id GROUP BY item_id""")
def service_search_summary(spark: S, sf: str) -> D:
    q = questions(spark, sf)
    n = index.search_texts(documents(spark, sf), q, 40).groupBy("query_id").agg(F.count("*").alias("n"))
    n = q.join(n, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = F.when(F.size(T.tokens(F.col("query"))) == 0, "no_query_words").when(F.col("n") > 5, "max_matches").otherwise("exhausted")
    return n.select("query_id", F.col("n").alias("candidates_scanned"), F.least("n", F.lit(5)).cast("long").alias("n_matches"), reason.alias("stopped_reason"))


@query(f"""{_service}, line AS (
  SELECT query_id, 0 AS kind, rank AS place, to_json({{'type': 'match', 'rank': rank::INTEGER, 'pmcid': pmcid}})::VARCHAR AS line FROM hit WHERE rank <= 5
  UNION ALL SELECT item_id, 1, 0, '{{"type":"not_found"}}' FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM hit)
  UNION ALL SELECT item_id, 2, 0, to_json({{'type': 'summary', 'n_matches': (SELECT count(*) FROM hit WHERE query_id = item_id AND rank <= 5)}})::VARCHAR FROM benchmark)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY kind, place)::INTEGER AS seq, line FROM line""")
def query_ndjson(spark: S, sf: str) -> D:
    from pyspark.sql import Window

    q = questions(spark, sf).select("query_id")
    hits = index.search_texts(documents(spark, sf), questions(spark, sf), 40).where("rank <= 5")
    found = q.join(hits, "query_id", "left").groupBy("query_id").agg(F.count("rank").alias("n"))
    match = hits.select("query_id", F.lit(0).alias("kind"), F.col("rank").alias("place"), F.to_json(F.struct(F.lit("match").alias("type"), "rank", F.col("chunk_ord").alias("pmcid"))).alias("line"))
    none = found.where("n = 0").select("query_id", F.lit(1).alias("kind"), F.lit(0).alias("place"), F.lit('{"type":"not_found"}').alias("line"))
    summary = found.select("query_id", F.lit(2).alias("kind"), F.lit(0).alias("place"), F.to_json(F.struct(F.lit("summary").alias("type"), F.col("n").alias("n_matches"))).alias("line"))
    lines = match.unionByName(none).unionByName(summary)
    return lines.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("kind", "place")).alias("seq"), "line")


@query(f"WITH {PARA} SELECT pmcid, section, ord::INTEGER AS ord, char_start, char_end, md5(text) AS text_md5 FROM paragraph")
def paragraph_offsets(spark: S, sf: str) -> D:
    return paragraphs(spark, sf).select("pmcid", "section", "ord", "char_start", "char_end", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT doc_id AS pmcid, lang AS section, md5(text) AS text_md5 FROM documents")
def section_text(spark: S, sf: str) -> D:
    return spans.section_text(raw_paragraphs(spark, sf)).select("pmcid", "section", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_probe = """s AS (SELECT l_orderkey * 7 + l_linenumber AS span_id, l_partkey % (SELECT count(*) + 20 FROM documents) AS pmcid, CASE WHEN l_linenumber = 7 THEN 'xx' ELSE 'en' END AS section, (l_suppkey * 5 % 3000)::INTEGER AS char_start, (l_suppkey * 5 % 3000 + l_quantity)::INTEGER AS char_end FROM lineitem)"""


@query(f"""WITH {_probe}, k AS (SELECT s.*, d.doc_id IS NOT NULL AS known, CASE WHEN d.lang = s.section THEN d.text END AS body FROM s LEFT JOIN documents d ON d.doc_id = pmcid)
SELECT span_id, pmcid, CASE WHEN NOT known THEN 'missing_file' WHEN body IS NULL THEN 'no_such_section_or_unparseable' WHEN NOT (char_start >= 0 AND char_start < char_end AND char_end <= length(body)) THEN 'out_of_range' END AS error,
  CASE WHEN body IS NOT NULL AND char_start >= 0 AND char_start < char_end AND char_end <= length(body) THEN md5(substring(body, char_start + 1, char_end - char_start)) END AS text_md5 FROM k""")
def load_span(spark: S, sf: str) -> D:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pmcid"), F.col("lang").alias("section"), "text")
    n = d.agg((F.count("*") + 20).alias("n"))
    at = F.col("l_suppkey") * 5 % 3000
    s = table(spark, sf, "lineitem").join(n).select((F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("span_id"), (F.col("l_partkey") % F.col("n")).alias("pmcid"), F.when(F.col("l_linenumber") == 7, "xx").otherwise("en").alias("section"), at.cast("int").alias("char_start"), (at + F.col("l_quantity")).cast("int").alias("char_end"))
    out = spans.dereference(s, d, d)
    return out.select("span_id", "pmcid", "error", F.md5(F.col("span_text").cast("binary")).alias("text_md5"))


_gold = "gold AS (SELECT item_id, doc_id AS pmcid, lang AS section, (instr(d.text, b.text) - 1)::INTEGER AS char_start, (instr(d.text, b.text) - 1 + length(b.text))::INTEGER AS char_end FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"""{_service}, late AS (SELECT item_id, item_id % 3 = 1 AS late FROM benchmark), line AS (
  SELECT query_id, 0 AS kind, rank AS place, to_json({{'type': 'match', 'rank': rank::INTEGER, 'pmcid': pmcid}})::VARCHAR AS line FROM hit JOIN late ON item_id = query_id WHERE rank <= 5 AND NOT late
  UNION ALL SELECT item_id, 0, 0, '{{"type":"error","code":"deadline"}}' FROM late WHERE late
  UNION ALL SELECT item_id, 1, 0, '{{"type":"not_found","candidates_scanned":0}}' FROM late WHERE NOT late AND item_id NOT IN (SELECT query_id FROM hit)
  UNION ALL SELECT item_id, 2, 0, to_json({{'type': 'summary', 'n_matches': CASE WHEN late THEN 0 ELSE least(n, 5) END, 'candidates_scanned': CASE WHEN late THEN 0 ELSE n END,
    'stopped_reason': CASE WHEN late THEN 'deadline' WHEN len({toks("text")}) = 0 THEN 'no_query_words' WHEN n > 5 THEN 'max_matches' ELSE 'exhausted' END}})::VARCHAR
    FROM (SELECT l.*, b.text, (SELECT count(*) FROM hit WHERE query_id = l.item_id) AS n FROM late l JOIN benchmark b USING (item_id)))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY kind, place)::INTEGER AS seq, line FROM line""")
def stream_with_deadline(spark: S, sf: str) -> D:
    """Three batches of queries at a time over one stored index, the second without any time to run."""
    stored = index.build(documents(spark, sf))
    path = files.shared_folder(spark)
    stored.save(path)
    stored = index.Index.load(spark, path)
    q = questions(spark, sf)
    batches = [(q.where(F.col("query_id") % 3 == k), 0.0 if k == 1 else 600.0) for k in range(3)]
    return serving.serve(spark, lambda queries: index.search(stored, queries, 40), batches, 3).lines


def gold_spans(spark: S, sf: str) -> D:
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pmcid"), F.col("lang").alias("section"), "text")
    return spans.verbatim(b, d).select("item_id", "pmcid", "section", "char_start", "char_end")


@query(f"WITH {PARA}, {_gold} SELECT item_id, g.pmcid, p.ord::INTEGER AS ord, p.char_start, p.char_end FROM gold g JOIN paragraph p ON g.pmcid = p.pmcid AND g.section = p.section AND g.char_start < p.char_end AND p.char_start < g.char_end")
def span_overlap_join(spark: S, sf: str) -> D:
    out = spans.overlap_join(gold_spans(spark, sf), paragraphs(spark, sf))
    return out.select("a.item_id", "a.pmcid", "b.ord", "b.char_start", "b.char_end")


_fold = f"""WITH RECURSIVE {PARA}, w AS (SELECT *, len({toks("text")}) AS n, title IN ('Acknowledgements', 'Data availability') AS skip FROM paragraph),
fold AS (
  SELECT pmcid, section, ord, CASE WHEN skip THEN -1 ELSE 0 END AS run, CASE WHEN skip THEN 0 ELSE 1 END AS held, CASE WHEN skip THEN 0 ELSE n END AS tokens, CASE WHEN skip THEN NULL ELSE title END AS t, skip FROM w WHERE ord = 0
  UNION ALL
  SELECT w.pmcid, w.section, w.ord,
    CASE WHEN w.skip THEN f.run WHEN f.held = 0 OR w.title IS DISTINCT FROM f.t OR f.tokens + w.n > 350 THEN f.run + 1 ELSE f.run END,
    CASE WHEN w.skip THEN 0 WHEN f.held = 0 OR w.title IS DISTINCT FROM f.t OR f.tokens + w.n > 350 THEN 1 ELSE f.held + 1 END,
    CASE WHEN w.skip THEN 0 WHEN f.held = 0 OR w.title IS DISTINCT FROM f.t OR f.tokens + w.n > 350 THEN w.n ELSE f.tokens + w.n END,
    CASE WHEN w.skip THEN NULL ELSE w.title END, w.skip
  FROM fold f JOIN w ON w.pmcid = f.pmcid AND w.section = f.section AND w.ord = f.ord + 1),
chunk AS (
  SELECT pmcid, section, run, string_agg(text, chr(10) ORDER BY ord) AS text, min(char_start) AS a, max(char_end) AS z, count(*) AS n_spans
  FROM fold JOIN w USING (pmcid, section, ord) WHERE NOT fold.skip GROUP BY ALL)"""


@query(f"{_fold} SELECT pmcid, section || '' AS section, pmcid || ':' || section || ':' || a || '-' || z AS chunk_id, n_spans, md5(text) AS text_md5 FROM chunk WHERE len({toks('text')}) >= 5")
def chunk_structure(spark: S, sf: str) -> D:
    c = chunking.structural(paragraphs(spark, sf))
    return c.select("pmcid", "section", "chunk_id", F.size("source_spans").cast("long").alias("n_spans"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {PARA} SELECT pmcid, section, pmcid || ':' || section || ':' || char_start || '-' || char_end AS chunk_id FROM paragraph WHERE len({toks('text')}) >= 5")
def chunk_paragraph(spark: S, sf: str) -> D:
    return chunking.paragraphs_as_chunks(paragraphs(spark, sf)).select("pmcid", "section", "chunk_id")


@query("SELECT doc_id AS chunk_ord, doc_id::VARCHAR AS chunk_id, length(text)::INTEGER AS char_end FROM documents")
def chunk_document(spark: S, sf: str) -> D:
    c = chunking.documents_as_chunks(table(spark, sf, "documents"), "doc_id")
    return c.select("chunk_ord", "chunk_id", F.get("source_spans", F.lit(0))["char_end"].alias("char_end"))


@query(f"{_fold} SELECT pmcid || ':' || section || ':' || a || '-' || z AS chunk_id, section, a AS char_start, z AS char_end FROM chunk WHERE len({toks('text')}) >= 5")
def chunk_span(spark: S, sf: str) -> D:
    c = chunking.structural(paragraphs(spark, sf)).select("chunk_id", spans.covering(F.col("source_spans")).alias("s"))
    return c.select("chunk_id", "s.section", "s.char_start", "s.char_end")


@query(f"{_fold}, {_gold} SELECT DISTINCT item_id, c.pmcid || ':' || c.section || ':' || a || '-' || z AS chunk_id FROM chunk c JOIN w ON w.pmcid = c.pmcid AND w.section = c.section JOIN fold f ON f.pmcid = w.pmcid AND f.section = w.section AND f.ord = w.ord AND NOT f.skip AND f.run = c.run JOIN gold g ON g.pmcid = c.pmcid AND g.section = c.section AND w.char_start < g.char_end AND g.char_start < w.char_end WHERE len({toks('c.text')}) >= 5")
def chunk_hits_gold(spark: S, sf: str) -> D:
    c = chunking.structural(paragraphs(spark, sf)).select("pmcid", "chunk_id", F.explode("source_spans").alias("s")).select("pmcid", "chunk_id", "s.*")
    return spans.overlap_join(gold_spans(spark, sf), c).select("a.item_id", "b.chunk_id").distinct()


@query(f"{_fold} SELECT p.pmcid, p.section, p.char_start, p.char_end FROM paragraph p WHERE (p.pmcid, p.section, p.char_start, p.char_end) NOT IN (SELECT w.pmcid, w.section, w.char_start, w.char_end FROM w JOIN fold f USING (pmcid, section, ord) JOIN chunk c ON c.pmcid = w.pmcid AND c.section = w.section AND c.run = f.run WHERE NOT f.skip AND len({toks('c.text')}) >= 5)")
def index_covers_gold(spark: S, sf: str) -> D:
    """Paragraph spans that no chunk of the index holds exactly."""
    p = paragraphs(spark, sf).select("pmcid", "section", "char_start", "char_end")
    c = chunking.structural(paragraphs(spark, sf)).select("pmcid", F.explode("source_spans").alias("s")).select("pmcid", "s.*")
    return p.join(c, ["pmcid", "section", "char_start", "char_end"], "left_anti")


@query(f"""WITH RECURSIVE {bm25(DOCS, ITEMS)}, {topk(10)}, r AS (SELECT query_id, rank, chunk_ord, length(text) AS n FROM run JOIN documents ON doc_id = chunk_ord),
pack AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS used, false AS took, NULL::BIGINT AS chunk_ord FROM (SELECT DISTINCT query_id FROM r)
  UNION ALL SELECT p.query_id, r.rank, CASE WHEN p.used + r.n <= 6000 THEN p.used + r.n ELSE p.used END, p.used + r.n <= 6000, r.chunk_ord FROM pack p JOIN r ON r.query_id = p.query_id AND r.rank = p.rank + 1)
SELECT query_id, rank::INTEGER AS rank, chunk_ord FROM pack WHERE took""")
def context_pack(spark: S, sf: str) -> D:
    """Hits in order of rank that fit what is left of 6,000 characters; one that doesn't fit is skipped."""
    size = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_ord"), F.length("text").alias("n"))
    hits = index.search_texts(documents(spark, sf), questions(spark, sf), 10).join(size, "chunk_ord")
    ranked = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_ord", "n"))).alias("h"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<rank:int,chunk_ord:bigint>>").alias("kept"))
    fold = F.aggregate("h", start, lambda a, h: F.when(a["used"] + h["n"] <= 6000, F.struct((a["used"] + h["n"]).alias("used"), F.concat(a["kept"], F.array(F.struct(h["rank"].alias("rank"), h["chunk_ord"].alias("chunk_ord")))).alias("kept"))).otherwise(a), lambda a: a["kept"])
    return ranked.select("query_id", F.explode(fold).alias("k")).select("query_id", "k.rank", "k.chunk_ord")
