"""Metrics, intervals, tests and samples over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import index, labels, metrics, sampling, service
from ..operators.tables import kept
from .base import DOCS, ITEMS, bm25, collapse, documents, query, questions, table, topk, wilson
from .retrieval import _gold, gold_spans

S, D = SparkSession, DataFrame

# an item's judgments: 2 where it stands verbatim, 1 for what the first 20 hits hold of its longer words, a fifth at least
_words = lambda t: f"list_distinct(list_filter(string_split(lower({collapse(t)}), ' '), lambda w: length(w) > 3))"
_qrels = f"""{_gold}, qrels AS (SELECT query_id, doc_id, max(rel) AS rel FROM (SELECT item_id AS query_id, pmcid AS doc_id, 2 AS rel FROM gold
  UNION ALL SELECT query_id, chunk_ord, 1 FROM run JOIN documents d ON d.doc_id = chunk_ord JOIN benchmark b ON b.item_id = query_id
  WHERE rank <= 20 AND len({_words("b.text")}) > 0 AND len(list_intersect({_words("b.text")}, {_words("d.text")})) / len({_words("b.text")})::DOUBLE >= 0.2) GROUP BY ALL)"""
_run = f"{bm25(DOCS, ITEMS)}, {topk(100)}, hits AS (SELECT query_id, rank, chunk_ord AS doc_id FROM run), {_qrels}"
_each = f"""{_run}, j AS (SELECT h.*, coalesce(rel, 0) AS rel FROM hits h LEFT JOIN qrels USING (query_id, doc_id)),
a AS (SELECT query_id, sum((rank <= 5 AND rel > 0)::INTEGER) AS h5, sum((rank <= 10 AND rel > 0)::INTEGER) AS h10, sum((rank <= 100 AND rel > 0)::INTEGER) AS h100, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1.0) END) AS dcg, min(CASE WHEN rel > 0 THEN rank END) AS first FROM j GROUP BY 1),
i AS (SELECT query_id, count(*) AS n, sum(CASE WHEN r <= 10 THEN rel / log2(r + 1.0) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS r FROM qrels WHERE rel > 0) GROUP BY 1),
m AS (SELECT item_id AS query_id, CASE WHEN n > 0 THEN coalesce(h5, 0) / n::DOUBLE END AS r5, CASE WHEN n > 0 THEN coalesce(h10, 0) / n::DOUBLE END AS r10, CASE WHEN n > 0 THEN coalesce(h100, 0) / n::DOUBLE END AS r100,
  CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg END AS ndcg, coalesce(1.0::DOUBLE / first, 0.0) AS mrr FROM benchmark LEFT JOIN a ON a.query_id = item_id LEFT JOIN i ON i.query_id = item_id)"""


def qrels(spark: S, sf: str, hits: D) -> D:
    """Judgments of gold spans and of ``hits``."""
    gold = gold_spans(spark, sf).select(F.col("item_id").alias("query_id"), F.col("pmcid").alias("doc_id"), F.lit(2).alias("rel"))
    d = documents(spark, sf).withColumnRenamed("chunk_ord", "doc_id")
    near = hits.where("rank <= 20").join(d, "doc_id").join(questions(spark, sf), "query_id").where(labels.word_overlap(F.col("query"), F.col("text")) >= 0.2)
    return gold.unionByName(near.select("query_id", "doc_id", F.lit(1).alias("rel"))).groupBy("query_id", "doc_id").agg(F.max("rel").alias("rel"))


def run(spark: S, sf: str, k: int = 100) -> D:
    return index.search_texts(documents(spark, sf), questions(spark, sf), k).select("query_id", "rank", F.col("chunk_ord").alias("doc_id"))


def each(spark: S, sf: str) -> D:
    hits = kept(run(spark, sf), "run")  # searched once, for the judgments and for the metrics
    return metrics.per_query(hits, qrels(spark, sf, hits), questions(spark, sf))


@query(f"WITH {_each} SELECT query_id, round(r5, 6) AS recall_5, round(r10, 6) AS recall_10, round(r100, 6) AS recall_100 FROM m")
def recall_at_k(spark: S, sf: str) -> D:
    return each(spark, sf).select("query_id", *[F.round(F.col(f"`recall@{k}`"), 6).alias(f"recall_{k}") for k in (5, 10, 100)])


@query(f"WITH {_each} SELECT query_id, round(mrr, 6) AS mrr FROM m")
def mrr(spark: S, sf: str) -> D:
    return each(spark, sf).select("query_id", F.round("mrr", 6).alias("mrr"))


@query(f"WITH {_each} SELECT query_id, round(ndcg, 6) AS ndcg FROM m")
def ndcg_at_k(spark: S, sf: str) -> D:
    return each(spark, sf).select("query_id", F.round(F.col("`ndcg@10`"), 6).alias("ndcg"))


_means = f"""WITH {_each}, l AS (SELECT 'recall@5' AS metric, r5 AS v FROM m UNION ALL SELECT 'recall@10', r10 FROM m UNION ALL SELECT 'recall@100', r100 FROM m UNION ALL SELECT 'ndcg@10', ndcg FROM m UNION ALL SELECT 'mrr', mrr FROM m)"""


@query(f"{_means} SELECT metric, round(coalesce(avg(v), 0), 6) AS value, count(v) AS n FROM l GROUP BY metric")
def evaluate_metrics(spark: S, sf: str) -> D:
    return metrics.means(metrics.long(each(spark, sf))).select("metric", F.round("value", 6).alias("value"), "n")


@query()
def bootstrap_ci(spark: S, sf: str) -> D:
    return stats.bootstrap(metrics.long(each(spark, sf)), "metric", "value")


@query("""WITH w AS (SELECT event_type, resample, value, ('0x' || substr(md5(event_id || ':' || resample), 1, 6))::BIGINT / 16777216.0::DOUBLE AS u FROM events, range(20) t(resample)),
x AS (SELECT *, CASE WHEN u < 0.3679 THEN 0 WHEN u < 0.7358 THEN 1 WHEN u < 0.9197 THEN 2 ELSE 3 END AS k FROM w)
SELECT event_type, resample::INTEGER AS resample, round(sum(value * k) / nullif(sum(k), 0), 6) AS mean FROM x GROUP BY ALL""")
def bootstrap_hash(spark: S, sf: str) -> D:
    out = stats.poisson_bootstrap(table(spark, sf, "events"), "event_type", "event_id", "value", 20)
    return out.select("event_type", "resample", F.round("mean", 6).alias("mean"))


@query("""WITH w AS (SELECT event_type, resample, value, ('0x' || substr(md5(event_id || ':' || resample), 1, 6))::BIGINT / 16777216.0::DOUBLE AS u FROM events, range(-1, 40) t(resample)),
x AS (SELECT *, CASE WHEN resample < 0 THEN 1 WHEN u < 0.3679 THEN 0 WHEN u < 0.7358 THEN 1 WHEN u < 0.9197 THEN 2 ELSE 3 END AS k,
  CASE WHEN value = 0 THEN 0 ELSE sign(value) * (ceil(ln(abs(value)) / ln(1.01::DOUBLE / 0.99::DOUBLE)) + 1073741824) END::BIGINT AS b FROM w),
bins AS (SELECT event_type, resample, b, sum(k)::DOUBLE AS k FROM x GROUP BY ALL),
upto AS (SELECT *, sum(k) OVER (PARTITION BY event_type, resample ORDER BY b) AS c, sum(k) OVER (PARTITION BY event_type, resample) AS t FROM bins),
q AS (SELECT event_type, resample, min(CASE WHEN c >= t * 0.95::DOUBLE AND k > 0 THEN CASE WHEN b = 0 THEN 0.0 ELSE sign(b) * pow(1.01::DOUBLE / 0.99::DOUBLE, abs(b) - 1073741824) * 0.99 END END) AS s, any_value(t) AS t FROM upto GROUP BY ALL),
l AS (SELECT event_type, list_sort(list(s) FILTER (resample >= 0)) AS s, max(s) FILTER (resample < 0) AS v, max(t) FILTER (resample < 0)::BIGINT AS n FROM q GROUP BY 1)
SELECT event_type, round(v, 6) AS value, round(s[2], 6) AS ci_low, round(s[40], 6) AS ci_high, n FROM l""")
def bootstrap_p95(spark: S, sf: str) -> D:
    """The 95th percentile of each kind of event with an interval, no kind in one task."""
    out = stats.bootstrap_of(table(spark, sf, "events"), "event_type", "event_id", "value", stats.quantile(0.95), 40)
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("value", "ci_low", "ci_high")], "n")


_gold_hits = f"""{_run}, g AS (SELECT h.*, (query_id, doc_id) IN (SELECT item_id, pmcid FROM gold) AS gold FROM hits h),
kept AS (SELECT *, min(CASE WHEN gold THEN rank END) OVER (PARTITION BY query_id) AS f FROM g),
closed AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, CASE WHEN gold THEN 'GOLD' ELSE doc_id::VARCHAR END AS doc_id FROM kept WHERE NOT gold OR rank = f)"""


def closed(spark: S, sf: str) -> D:
    gold = gold_spans(spark, sf).select(F.col("item_id").alias("query_id"), F.col("pmcid").alias("doc_id")).distinct().withColumn("gold", F.lit(True))
    hits = run(spark, sf).join(gold, ["query_id", "doc_id"], "left").withColumn("gold", F.coalesce("gold", F.lit(False)))
    return metrics.relabel_gold(hits)


@query(f"WITH {_gold_hits} SELECT query_id, rank::INTEGER AS rank, doc_id FROM closed")
def gold_relabel(spark: S, sf: str) -> D:
    return closed(spark, sf)


_rank = f"{_gold_hits}, r AS (SELECT item_id AS query_id, min(CASE WHEN doc_id = 'GOLD' THEN rank END)::INTEGER AS rank, item_id % 4 AS stratum, item_id % 2 AS style, item_id // 2 AS paragraph FROM benchmark LEFT JOIN closed ON query_id = item_id GROUP BY item_id)"


def ranks(spark: S, sf: str) -> D:
    first = closed(spark, sf).where("doc_id = 'GOLD'").groupBy("query_id").agg(F.min("rank").alias("rank"))
    q = questions(spark, sf).select("query_id").join(first, "query_id", "left")
    return q.withColumns({"stratum": F.col("query_id") % 4, "style": F.col("query_id") % 2, "paragraph": F.floor(F.col("query_id") / 2)})


@query(f"WITH {_rank} SELECT query_id, rank, coalesce(rank <= 10, false) AS hit_10 FROM r")
def rank_of_gold(spark: S, sf: str) -> D:
    return ranks(spark, sf).select("query_id", "rank", F.coalesce(F.col("rank") <= 10, F.lit(False)).alias("hit_10"))


_lo, _hi = wilson("s", "n")
_share = f"round(s / n::DOUBLE, 4) AS value, round({_lo}, 4) AS ci_low, round({_hi}, 4) AS ci_high, n"


def hit():
    return F.coalesce(F.col("rank") <= 10, F.lit(False))


@query(f"WITH {_rank}, shares AS (SELECT stratum, sum(coalesce(rank <= 10, false)::INTEGER) AS s, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 5) SELECT stratum, {_share} FROM shares")
def recall_by_stratum(spark: S, sf: str) -> D:
    return metrics.share_by(ranks(spark, sf), ["stratum"], hit(), 5)


@query(f"WITH {_rank}, shares AS (SELECT stratum, style, sum(coalesce(rank <= 10, false)::INTEGER) AS s, count(*) AS n FROM r GROUP BY ALL) SELECT stratum, style, {_share} FROM shares")
def recall_by_axis(spark: S, sf: str) -> D:
    return metrics.share_by(ranks(spark, sf), ["stratum", "style"], hit())


_bands = (0.0, 0.5, 0.65, 0.8, 0.9, 1.01)


_mc = "CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) + (b + c) * ln(0.5))))) END"


@query(f"WITH {_rank}, p AS (SELECT paragraph, bool_or(style = 0 AND coalesce(rank <= 10, false)) AS x, bool_or(style = 1 AND coalesce(rank <= 10, false)) AS y FROM r GROUP BY 1 HAVING count(*) = 2), t AS (SELECT count(*) AS n_pairs, sum((x AND NOT y)::INTEGER)::BIGINT AS b, sum((y AND NOT x)::INTEGER)::BIGINT AS c FROM p) SELECT n_pairs, b, c, round({_mc}, 6) AS p FROM t")
def paired_style_mcnemar(spark: S, sf: str) -> D:
    p = ranks(spark, sf).withColumn("hit", hit()).groupBy("paragraph").agg(F.bool_or((F.col("style") == 0) & F.col("hit")).alias("x"), F.bool_or((F.col("style") == 1) & F.col("hit")).alias("y"), F.count("*").alias("k")).where("k = 2")
    t = p.agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum((F.col("x") & ~F.col("y")).cast("long")), F.lit(0)).alias("b"), F.coalesce(F.sum((F.col("y") & ~F.col("x")).cast("long")), F.lit(0)).alias("c"))
    return t.select("n_pairs", "b", "c", F.round(stats.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


@query(f"WITH t AS (SELECT DISTINCT l_linenumber + 0 AS b, (l_suppkey % 30)::INTEGER AS c FROM lineitem) SELECT b, c, round({_mc}, 6) AS p FROM t")
def mcnemar_exact(spark: S, sf: str) -> D:
    t = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("b"), (F.col("l_suppkey") % 30).cast("int").alias("c")).distinct()
    return t.select("b", "c", F.round(stats.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


@query(f"WITH t AS (SELECT p_brand, sum((p_size <= 10)::INTEGER) AS s, count(*) AS n FROM part GROUP BY 1) SELECT p_brand, {_share} FROM t")
def wilson_ci(spark: S, sf: str) -> D:
    return metrics.share_by(table(spark, sf, "part"), ["p_brand"], F.col("p_size") <= 10)


@query("""WITH c AS (SELECT quality::INTEGER AS i, toxic::INTEGER AS j, count(*) AS c FROM labels GROUP BY ALL), n AS (SELECT sum(c)::DOUBLE AS n, sum(CASE WHEN i = j THEN c ELSE 0 END) AS o FROM c),
e AS (SELECT sum(CASE WHEN i = j THEN r * q ELSE 0 END) AS e FROM (SELECT i, sum(c) AS r FROM c GROUP BY i), (SELECT j, sum(c) AS q FROM c GROUP BY j))
SELECT n::BIGINT AS n, round((o / n - e / (n * n)) / (1 - e / (n * n)), 6) AS unweighted, round((o / n - e / (n * n)) / (1 - e / (n * n)), 6) AS weighted FROM n, e""")
def cohens_kappa(spark: S, sf: str) -> D:
    pairs = table(spark, sf, "labels").select(F.col("quality").cast("string").alias("a"), F.col("toxic").cast("string").alias("b"))
    return metrics.kappa(pairs, "a", "b", ("0", "1")).select("n", F.round("unweighted", 6).alias("unweighted"), F.round("weighted", 6).alias("weighted"))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(count(*) / nullif(epoch(max(ts)) - epoch(min(ts)), 0), 6) AS per_second FROM events GROUP BY 1")
def latency_percentiles(spark: S, sf: str) -> D:
    out = service.latencies(table(spark, sf, "events"), ["event_type"], "value", "ts")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "per_second")])


@query("SELECT arg_max(lang, (n, lang)) AS value, round(max(n) / sum(n)::DOUBLE, 6) AS rate, sum(n)::BIGINT AS n FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1)")
def majority_baseline(spark: S, sf: str) -> D:
    return service.majority(table(spark, sf, "documents"), "lang").select("value", F.round("rate", 6).alias("rate"), "n")


@query("SELECT split_part(props, ':', 1) || event_type AS reason, count(*) AS n FROM events GROUP BY 1")
def reject_histogram(spark: S, sf: str) -> D:
    # the reasons' prefixes stand before the first colon; the kind of event makes them differ
    return service.reasons(table(spark, sf, "events"), F.concat(F.substring_index("props", ":", 1), "event_type"))


@query("SELECT l_returnflag AS style, round(avg(l_discount * 10), 6) AS mean, round(median(l_discount * 10), 6) AS median, round(avg((l_discount >= 0.09)::INTEGER), 6) AS high FROM lineitem GROUP BY 1")
def calibrate_overlap(spark: S, sf: str) -> D:
    out = service.overlap_profile(table(spark, sf, "lineitem"), "l_returnflag", F.col("l_discount") * 10, F.col("l_discount") >= 0.09)
    return out.select("style", *[F.round(c, 6).alias(c) for c in ("mean", "median", "high")])


@query("""WITH g(max_rank, min_margin) AS (SELECT * FROM (VALUES (1), (3), (5)) a(x), (VALUES (0.0::DOUBLE), (0.02), (0.05)) b(y))
SELECT l_returnflag AS verdict, max_rank, min_margin, count(*) AS n, sum((l_linenumber > max_rank OR l_tax < min_margin)::INTEGER)::BIGINT AS rejected, round(list_sort(list(l_tax))[(count(*) // 2 + 1)::BIGINT], 6) AS median FROM lineitem, g GROUP BY ALL""")
def calibrate_specificity(spark: S, sf: str) -> D:
    g = spark.sql("SELECT * FROM VALUES (1), (3), (5) AS a(max_rank), VALUES (0.0D), (0.02D), (0.05D) AS b(min_margin)")
    out = service.threshold_grid(table(spark, sf, "lineitem"), "l_returnflag", "l_linenumber", "l_tax", g)
    return out.withColumn("median", F.round("median", 6))


@query("""WITH o AS (SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice, o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderpriority, o_orderkey FROM o WHERE r = 1""")
def best_candidate(spark: S, sf: str) -> D:
    return sampling.first_per(table(spark, sf, "orders"), ["o_custkey"], ["o_orderpriority", "o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT c_custkey FROM customer ORDER BY md5('0:' || c_custkey), c_custkey LIMIT 50")
def hash_sample(spark: S, sf: str) -> D:
    return sampling.sample(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 50)


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('0:' || o_orderkey), o_orderkey) AS s FROM a WHERE r = 1) SELECT o_orderpriority, o_orderkey FROM b WHERE s <= 20""")
def stratified_quota(spark: S, sf: str) -> D:
    one = sampling.first_per(table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderpriority"], ["o_orderkey"])
    return sampling.first_per(one, ["o_orderpriority"], [sampling.shuffle_key("o_orderkey"), "o_orderkey"], 20).select("o_orderpriority", "o_orderkey")


@query("WITH a AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5('0:' || p_partkey), p_partkey) AS r FROM part) SELECT p_partkey, p_brand FROM a ORDER BY r, p_brand LIMIT 60")
def round_robin(spark: S, sf: str) -> D:
    return sampling.round_robin(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 60)


@query("WITH a AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('3:' || c_custkey), c_custkey) AS r FROM customer) SELECT c_custkey, c_mktsegment FROM a ORDER BY r > 1, md5('3:' || c_custkey), c_custkey LIMIT 40")
def sample_each_type(spark: S, sf: str) -> D:
    """40 customers by hash order, at least one of each segment."""
    return sampling.each_and_more(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 40, 3)


@query("""WITH b AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 10 = 0 THEN CASE WHEN o_orderkey % 20 = 0 THEN 'held_out' ELSE 'dev' END END AS before FROM orders),
n AS (SELECT o_orderpriority, count(*) AS n, sum((before = 'held_out')::INTEGER) AS done FROM b GROUP BY 1),
r AS (SELECT b.*, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('0:' || o_orderkey), o_orderkey) AS r FROM b WHERE before IS NULL)
SELECT o_orderkey, o_orderpriority, CASE WHEN r <= greatest(0, round(n * 0.4)::BIGINT - coalesce(done, 0)) THEN 'held_out' ELSE 'dev' END AS split FROM r JOIN n USING (o_orderpriority) UNION ALL SELECT o_orderkey, o_orderpriority, before FROM b WHERE before IS NOT NULL""")
def stratified_split(spark: S, sf: str) -> D:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    done = o.where("o_orderkey % 10 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 20 == 0, "held_out").otherwise("dev").alias("split"))
    return sampling.split(o, "o_orderkey", "o_orderpriority", done)


@query("WITH a AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5('0:' || l_linenumber), l_partkey, l_suppkey) AS r FROM lineitem) SELECT l_orderkey, l_linenumber FROM a WHERE r = 1")
def one_per_group(spark: S, sf: str) -> D:
    return sampling.first_per(table(spark, sf, "lineitem"), ["l_orderkey"], [sampling.shuffle_key("l_linenumber"), "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")
