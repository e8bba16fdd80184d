"""What runs leave behind, and cases by all their rules, over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bundle, cases, index, lineage, serving
from ..session import shared
from ..sources import files
from .base import DOCS, ITEMS, bm25, collapse, documents, query, questions, table, topk, toks
from .corpus import _made, _share, made

S, D = SparkSession, DataFrame


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def jsonl_scan(spark: S, sf: str) -> D:
    """Customers as JSON lines with blank lines between, read back."""
    path = files.shared_folder(spark)
    row = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    table(spark, sf, "customer").select(F.explode(F.array(row, F.lit(""), F.lit("  "))).alias("value")).write.text(path)
    return files.jsonl(spark, path, "id long, name string, segment string")


@query(f"WITH {bm25(DOCS, ITEMS)}, {topk(10)} SELECT query_id, chunk_ord, rank::INTEGER AS rank, score FROM run")
def stored_search(spark: S, sf: str) -> D:
    """Search over an index that was saved and loaded."""
    path = files.shared_folder(spark)
    index.build(documents(spark, sf)).save(path)
    return index.search(index.Index.load(spark, path), questions(spark, sf), 10).select("query_id", "chunk_ord", "rank", "score")


@query(f"WITH {bm25(DOCS, ITEMS)} SELECT CASE WHEN n_docs > 0 THEN 200 ELSE 503 END AS status, n_docs FROM corpus")
def health_check(spark: S, sf: str) -> D:
    n = index.build(documents(spark, sf)).corpus.first()["n_docs"]
    return spark.createDataFrame([(serving.health(n)[0], n)], "status int, n_docs long")


@query("""SELECT o_orderkey, o_totalprice, 'cfg-' || substr(sha256('{"b": 0.75, "k1": 1.5}'), 1, 12) AS config_hash FROM orders WHERE o_orderstatus = 'P'""")
def run_sink(spark: S, sf: str) -> D:
    """Results and what made them, written beside each other and read back as one."""
    path = files.shared_folder(spark)
    rows = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    lineage.write_run(rows, path, {"k1": 1.5, "b": 0.75})
    meta = spark.read.schema("config_hash string").json(f"{path}/meta")
    back = spark.read.schema("o_orderkey long, o_totalprice double").json(f"{path}/results")
    return back.join(meta)  # one row


@query("SELECT role, name, 'ok' AS copy, n::BIGINT AS n FROM (VALUES ('input', 'nation', 1), ('input', 'region', 1), ('result', 'results', 1), ('source', 'source.zip', 1)) t(role, name, n)")
def bundle_verified(spark: S, sf: str) -> D:
    """A run over two of the tables, registered and verified against its copies."""
    registry, out = (f"{shared(spark)}/{name}-{uuid.uuid4().hex}" for name in ("registry", "out"))
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").count().coalesce(1).write.parquet(out)
    run = bundle.register(spark, registry, {"top": 1}, {t: f"{sf}/{t}.parquet" for t in ("nation", "region")}, out, {"rows": 5})
    return bundle.verified(spark, registry, run).groupBy("role", "name", "copy").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT item_id, unnest(['## item ' || item_id, '- text: ' || text, CASE WHEN item_id % 2 = 0 THEN '- even: yes' END, 'verdict: ', '']) AS line FROM benchmark) SELECT md5(line) AS line_md5, count(*) AS n FROM l WHERE line IS NOT NULL GROUP BY 1""")
def worksheet_lines(spark: S, sf: str) -> D:
    b = table(spark, sf, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 2 == 0, "yes").alias("even"))
    out = lineage.worksheet(b, ["text", "even"], F.concat(F.lit("item "), F.col("item_id").cast("string")))
    return out.groupBy(F.md5(F.col("line").cast("binary")).alias("line_md5")).agg(F.count("*").alias("n"))


@query("SELECT r_name AS split, (r_regionkey + 1)::BIGINT AS touches, r_regionkey + 1 > 3 AS over FROM region")
def touch_ledger(spark: S, sf: str) -> D:
    """A region is touched as often as its number says, and once more; above three there is a warning."""
    path = files.shared_folder(spark)
    for r in table(spark, sf, "region").select("r_name", "r_regionkey").collect():  # five regions
        for _ in range(int(r["r_regionkey"]) + 1):
            lineage.record_touch(spark, path, r["r_name"], "scored")
    seen = spark.read.schema(lineage.TOUCHES).json(path).groupBy("split").agg(F.count("*").alias("touches"))
    return seen.withColumn("over", F.col("touches") > lineage.MOST_TOUCHES)


# --- cases by all rules: what their words say, how rare these are, and whether another article answers as well ---
_terms = f"df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) GROUP BY 1)"
_n = lambda x: f"len({toks(x)})"
_normal = lambda x: collapse(f"translate(lower({x}), '‐‑‒–—−', '------')")
_anchor = "list_filter([substr(text, 1, 12), 'lost words', substr(text, 1, 90)], lambda a: len(string_split(" + collapse("a") + ", ' ')) <= 8 AND " + collapse("a") + " <> '' AND contains(" + _normal("text") + ", " + _normal("a") + "))"
_bare = lambda x: f"list_sort(list_filter(list_distinct({toks(x)}), lambda w: NOT list_contains(known, w)))"


@query(f"""WITH {_made}, {_terms}, m AS (SELECT *, paragraph AS text FROM made),
w AS (SELECT pmcid, ord, style, term FROM (SELECT pmcid, ord, 'l' AS style, unnest({toks('lexical')}) AS term FROM m UNION ALL SELECT pmcid, ord, 'p', unnest({toks('paraphrased')}) FROM m)),
f AS (SELECT pmcid, ord, min(df) FILTER (style = 'l') AS l, min(df) FILTER (style = 'p') AS p FROM w JOIN df USING (term) GROUP BY ALL),
c AS (SELECT m.*, coalesce(l, 1073741824) AS ldf, coalesce(p, 1073741824) AS pdf, CASE WHEN pmcid % 4 > 0 THEN (ord % 8 + 1)::INTEGER END AS rank, (pmcid % 7 - 2) / 10.0::DOUBLE AS margin, {_anchor} AS anchors FROM m LEFT JOIN f USING (pmcid, ord)),
k AS (SELECT *, flatten(list_transform(anchors, lambda a: {toks('a')})) AS known FROM c)
SELECT pmcid, ord, len(anchors) AS n_anchors, CASE WHEN answer IS NULL OR {collapse('answer')} = '' THEN 'declined' WHEN NOT contains({_normal('paragraph')}, {_normal('answer')}) THEN 'not_verbatim' WHEN {_n('answer')} > 12 THEN 'long_answer'
WHEN lexical IS NULL OR {collapse('lexical')} = '' THEN 'lexical_missing' WHEN paraphrased IS NULL OR {collapse('paraphrased')} = '' THEN 'paraphrased_missing'
WHEN {_n('lexical')} NOT BETWEEN 5 AND 60 THEN 'lexical_length' WHEN {_share('answer', 'lexical')} > 0.7 THEN 'lexical_tautological' WHEN ldf > 20 THEN 'lexical_generic'
WHEN {_n('paraphrased')} NOT BETWEEN 5 AND 60 THEN 'paraphrased_length' WHEN {_share('answer', 'paraphrased')} > 0.7 THEN 'paraphrased_tautological' WHEN pdf > 20 THEN 'paraphrased_generic'
WHEN rank IS NULL OR rank > 5 OR margin < 0 THEN 'generic' WHEN {_normal('lexical')} = {_normal('paraphrased')} THEN 'identical' WHEN {_bare('lexical')} = {_bare('paraphrased')} THEN 'anchors_only' END AS reason FROM k""")
def validate_by_all_rules(spark: S, sf: str) -> D:
    """The made cases with anchors, the rarity of their words in the index (20 articles at most) and a rank and
    margin of each."""
    c = made(spark, sf)
    terms = index.build(documents(spark, sf)).terms
    low = {}
    for style in ("lexical", "paraphrased"):
        q = c.select(F.struct("pmcid", "ord").alias("query_id"), F.col(style).alias("query"))
        low[style] = cases.rarest_df(q, terms).select(F.col("query_id.pmcid").alias("pmcid"), F.col("query_id.ord").alias("ord"), F.col("rarest_df").alias(f"{style}_df"))
        c = c.join(low[style], ["pmcid", "ord"])
    t = F.col("paragraph")
    anchors = cases.usable_anchors(F.array(F.substring(t, 1, 12), F.lit("lost words"), F.substring(t, 1, 90)), t)
    c = c.withColumn("anchors", anchors).withColumn("rank", F.when(F.col("pmcid") % 4 > 0, F.col("ord") % 8 + 1)).withColumn("margin", (F.col("pmcid") % 7 - 2) / 10.0)
    columns = {k: F.col(k) for k in ("answer", "paragraph", "lexical", "paraphrased", "anchors", "lexical_df", "paraphrased_df", "rank", "margin")}
    return c.select("pmcid", "ord", F.size("anchors").cast("long").alias("n_anchors"), cases.rejection(columns, most_df=20).alias("reason"))
