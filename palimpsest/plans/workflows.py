"""Whole workflows of verification, mining and review over the given tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..operators import index, labels, metrics, mining, service, spans, verification
from ..sources import files
from .base import DOCS, ITEMS, ORACLES, PARA, bm25, collapse, documents, paragraphs, query, questions, raw_paragraphs, table, toks, topk, wilson
from .corpus import SETS, _coverage, _held, sentences, word_pairs
from .evaluation import _mc, hit, ranks, _rank, _share
from .retrieval import _gold, gold_spans
from .texts import _numbers

S, D = SparkSession, DataFrame
md5 = lambda c: F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))

# --- statistics with large counts and several levels ---


@query(f"""WITH g AS (SELECT l_linenumber AS g, sum((l_quantity > 25)::INTEGER)::BIGINT AS b, sum((l_quantity <= 25)::INTEGER)::BIGINT AS c FROM lineitem GROUP BY 1),
t AS (SELECT g, b, c FROM g UNION ALL SELECT g + 100, b, b FROM g UNION ALL SELECT 1000 + g, b, b - g * 20 FROM g)
SELECT g, b, c, round({_mc}, 6) AS p FROM t""")
def mcnemar_large(spark: S, sf: str) -> D:
    """Thousands of discordant pairs, equal counts among them."""
    big = F.col("l_quantity") > 25
    g = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("g")).agg(F.sum(big.cast("long")).alias("b"), F.sum((~big).cast("long")).alias("c"))
    t = g.unionByName(g.select((F.col("g") + 100).alias("g"), "b", F.col("b").alias("c"))).unionByName(g.select((F.col("g") + 1000).alias("g"), "b", (F.col("b") - F.col("g") * 20).alias("c")))
    return t.select("g", "b", "c", F.round(stats.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


@query("""WITH x AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS i, CASE WHEN l_linenumber = 7 THEN CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END ELSE (l_linenumber % 3)::INTEGER END AS j FROM lineitem),
c AS (SELECT i, j, count(*) AS c FROM x GROUP BY ALL), n AS (SELECT sum(c)::DOUBLE AS n, sum(c * (i = j)::INTEGER)::DOUBLE AS o, sum(c * (1 - abs(i - j) / 2.0::DOUBLE)) AS ow FROM c),
e AS (SELECT sum(r * q * (i = j)::INTEGER)::DOUBLE AS e, sum(r * q * (1 - abs(i - j) / 2.0::DOUBLE)) AS ew FROM (SELECT i, sum(c) AS r FROM c GROUP BY i), (SELECT j, sum(c) AS q FROM c GROUP BY j))
SELECT n::BIGINT AS n, round((o / n - e / (n * n)) / (1 - e / (n * n)), 6) AS unweighted, round((ow / n - ew / (n * n)) / (1 - ew / (n * n)), 6) AS weighted,
  CASE WHEN (ow / n - ew / (n * n)) / (1 - ew / (n * n)) >= 0.8 THEN 'almost perfect' WHEN (ow / n - ew / (n * n)) / (1 - ew / (n * n)) >= 0.6 THEN 'substantial' WHEN (ow / n - ew / (n * n)) / (1 - ew / (n * n)) >= 0.4 THEN 'moderate'
  WHEN (ow / n - ew / (n * n)) / (1 - ew / (n * n)) >= 0.2 THEN 'fair' ELSE 'no better than chance / slight' END AS reading FROM n, e""")
def kappa_levels(spark: S, sf: str) -> D:
    """Three ordered levels, where the weighted agreement differs from the unweighted one."""
    a = F.col("l_returnflag")
    other = F.get(F.array(*map(F.lit, "ANR")), (F.col("l_linenumber") % 3).cast("int"))
    pairs = table(spark, sf, "lineitem").select(a.alias("a"), F.when(F.col("l_linenumber") == 7, a).otherwise(other).alias("b"))
    return metrics.kappa(pairs, "a", "b", ("A", "N", "R")).select("n", F.round("unweighted", 6).alias("unweighted"), F.round("weighted", 6).alias("weighted"), metrics.agreement(F.col("weighted")).alias("reading"))


# --- an item against the documents that a search finds for it ---
_hits = f"{bm25(DOCS, ITEMS)}, {topk(20)}, p AS (SELECT query_id, chunk_ord AS doc_id, q.text AS q, d.text AS t FROM run JOIN benchmark q ON q.item_id = query_id JOIN documents d ON d.doc_id = chunk_ord)"
_part = lambda a, b, empty: f"round(CASE WHEN len({a}) = 0 THEN {empty} ELSE len(list_intersect({a}, {b})) / len({a})::DOUBLE END, 6)"


def found_texts(spark: S, sf: str, k: int = 20) -> D:
    d, q = documents(spark, sf), questions(spark, sf)
    return index.search_texts(d, q, k).join(d, "chunk_ord").join(q, "query_id").withColumnRenamed("chunk_ord", "doc_id")


@query(f"WITH {_hits}, w AS (SELECT query_id, doc_id, list_distinct({toks('q')}) AS a, list_distinct({toks('t')}) AS b FROM p) SELECT query_id, doc_id, {_part('a', 'b', '0.0')} AS overlap, {_part('b', 'a', '1.0')} AS answer_share FROM w")
def hit_overlap(spark: S, sf: str) -> D:
    """How much of a query a hit holds, and how much of the hit, as an answer, the query gives away."""
    q, t = F.col("query"), F.col("text")
    return found_texts(spark, sf).select("query_id", "doc_id", F.round(T.overlap_share(q, t), 6).alias("overlap"), F.round(T.overlap_share(t, q, 1.0), 6).alias("answer_share"))


@query(f"""WITH {_rank}, f AS (SELECT query_id, chunk_ord FROM run WHERE rank = 1), o AS (SELECT r.query_id, r.rank, r.style, coalesce({_part(f"list_distinct({toks('b.text')})", f"list_distinct({toks('d.text')})", '0.0')}, 0.0) AS overlap FROM r JOIN benchmark b ON b.item_id = r.query_id LEFT JOIN f ON f.query_id = r.query_id LEFT JOIN documents d ON d.doc_id = f.chunk_ord),
shares AS (SELECT CASE WHEN overlap < 0.5 THEN 0 WHEN overlap < 0.65 THEN 1 WHEN overlap < 0.8 THEN 2 WHEN overlap < 0.9 THEN 3 ELSE 4 END AS band, style, sum(coalesce(rank <= 10, false)::INTEGER) AS s, count(*) AS n FROM o GROUP BY ALL) SELECT band, style, {_share} FROM shares""")
def recall_by_hit_overlap(spark: S, sf: str) -> D:
    """Recall by how much of the query its first hit holds."""
    first = found_texts(spark, sf, 1).select("query_id", F.round(T.overlap_share(F.col("query"), F.col("text")), 6).alias("overlap"))
    band = F.lit(0)
    for edge in (0.5, 0.65, 0.8, 0.9):
        band = band + (F.coalesce("overlap", F.lit(0.0)) >= edge).cast("int")
    return metrics.share_by(ranks(spark, sf).join(first, "query_id", "left").withColumn("band", band), ["band", "style"], hit())


# --- quotes ---
_cut = lambda b: f"list_filter(string_split(regexp_replace({b}, '([.;])[ \\t\\n\\r\\f\\x{{0B}}\\x{{00A0}}\\x{{2009}}\\x{{202F}}]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) >= 15)"
_note = "replace(replace(text, ', ', ''''), 'e ', 'e; ')"


@query(f"""WITH q AS (SELECT doc_id, list_filter(list_filter(string_split({_note}, ''''), lambda x, i: i % 2 = 0), lambda x: length(x) >= 15) AS q FROM documents),
b AS (SELECT doc_id, unnest(range(len(q))) AS i, unnest(q) AS b FROM q), c AS (SELECT doc_id, i, 0 AS j, b AS x FROM b UNION ALL SELECT doc_id, i, unnest(range(1, 1 + len({_cut('b')}))), unnest({_cut('b')}) FROM b),
f AS (SELECT doc_id, x, min((i, j)) AS pos FROM c GROUP BY doc_id, x)
SELECT doc_id, count(*) AS n, md5(string_agg(x, '|' ORDER BY pos)) AS quotes_md5 FROM f GROUP BY doc_id""")
def quote_fallbacks(spark: S, sf: str) -> D:
    """Quotes and, after each, the sentences inside it."""
    note = F.replace(F.replace("text", F.lit(", "), F.lit("'")), F.lit("e "), F.lit("e; "))
    q = table(spark, sf, "documents").select("doc_id", T.quote_candidates(note).alias("q")).where("size(q) > 0")
    return q.select("doc_id", F.size("q").cast("long").alias("n"), md5(F.array_join("q", "|")).alias("quotes_md5"))


# --- spans: each document's first line is its abstract, the rest its body; the note quotes the second line ---
_article = """article AS (SELECT doc_id AS pmcid, 'abstract' AS section, split_part(text, chr(10), 1) AS text FROM documents WHERE doc_id % 13 > 0
  UNION ALL SELECT doc_id, 'body', substr(text, instr(text, chr(10)) + 1) FROM documents WHERE instr(text, chr(10)) > 0 AND doc_id % 11 > 0)"""
_claimed = f"""{_article}, l AS (SELECT doc_id, trim(substr(split_part(text, chr(10), 2), 1, 40)) AS q, length(split_part(text, chr(10), 2)) AS n FROM documents),
claimed AS (SELECT doc_id AS span_id, CASE WHEN doc_id % 17 = 0 THEN doc_id + 100000000 ELSE doc_id END AS pmcid, CASE WHEN doc_id % 5 = 0 THEN 'abstract' ELSE 'body' END AS section, 0 AS char_start, (CASE WHEN doc_id % 4 = 0 THEN n WHEN doc_id % 4 = 1 THEN 9000000 ELSE 12 END)::INTEGER AS char_end,
  CASE WHEN length(q) >= 15 AND NOT regexp_matches(q, '[ \\t\\n\\r\\f\\x{{0B}}\\x{{00A0}}\\x{{2009}}\\x{{202F}}]{{2,}}|[\\n\\r\\t‘’“”–—''.;]') THEN q END AS q, 'c.' || CASE WHEN doc_id % 3 = 0 THEN 'zzzzq' ELSE substr(q, 2, 6) END AS variant, CASE WHEN doc_id % 6 = 0 THEN 'zzzzq' ELSE 'the' END AS gene FROM l)"""
_subject = lambda t: f"CASE WHEN contains({t}, regexp_replace(variant, '^(c|p)\\.', '')) THEN 'ok' WHEN regexp_matches(lower({t}), '\\b' || gene || '\\b') THEN 'gene_only' ELSE 'absent' END"


def articles(spark: S, sf: str) -> D:
    d = table(spark, sf, "documents")
    first = d.where("doc_id % 13 > 0").select(F.col("doc_id").alias("pmcid"), F.lit("abstract").alias("section"), F.substring_index("text", "\n", 1).alias("text"))
    rest = d.where("doc_id % 11 > 0 and instr(text, '\n') > 0").select(F.col("doc_id").alias("pmcid"), F.lit("body").alias("section"), F.expr("substring(text, instr(text, '\n') + 1)").alias("text"))
    return first.unionByName(rest)


def claimed(spark: S, sf: str) -> D:
    line = F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit(""))
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", F.trim(F.substring(line, 1, 40)).alias("q"), F.length(line).alias("n"))
    plain = (F.length("q") >= 15) & ~F.col("q").rlike(r"[ \t\n\r\f\x0B\x{00A0}\x{2009}\x{202F}]{2,}|[\n\r\t‘’“”–—'.;]")
    # every other note has another sentence before the quote, so that only the sentence is found
    note = F.when(plain, F.concat(F.lit("it says '"), F.when(k % 2 == 0, F.lit("This was never written there at all. ")).otherwise(""), "q", F.lit("' and so on"))).otherwise("short 'note'")
    end = F.when(k % 4 == 0, F.col("n")).when(k % 4 == 1, 9_000_000).otherwise(12).cast("int")
    variant = F.concat(F.lit("c."), F.when(k % 3 == 0, "zzzzq").otherwise(F.substring("q", 2, 6)))
    return d.select(k.alias("span_id"), F.when(k % 17 == 0, k + 100_000_000).otherwise(k).alias("pmcid"), F.when(k % 5 == 0, "abstract").otherwise("body").alias("section"), F.lit(0).alias("char_start"), end.alias("char_end"), note.alias("note"), variant.alias("variant"), F.when(k % 6 == 0, "zzzzq").otherwise("the").alias("gene"))


@query(f"""WITH {_claimed}, h AS (SELECT span_id, a.section AS sec, a.text, c.q, c.variant, c.gene, instr(a.text, c.q) - 1 AS pos FROM claimed c JOIN article a ON a.pmcid = c.pmcid WHERE c.q IS NOT NULL AND contains(a.text, c.q)),
e AS (SELECT *, (pos - coalesce(nullif(instr(reverse(substr(text, 1, pos::BIGINT)), chr(10)), 0), pos + 1) + 1)::INTEGER AS a, (CASE WHEN instr(substr(text, (pos + length(q) + 1)::BIGINT), chr(10)) > 0 THEN pos + length(q) + instr(substr(text, (pos + length(q) + 1)::BIGINT), chr(10)) - 1 ELSE length(text) END)::INTEGER AS z FROM h),
g AS (SELECT span_id, sec, a, z, {_subject("substr(text, a + 1, z - a)")} AS subject FROM e QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY sec) = 1),
r AS (SELECT c.*, o.text AS own, d.doc_id IS NOT NULL AS known, g.sec, g.a, g.z, g.subject AS s, c.char_end <= length(o.text) AND c.char_end > 0 AS fits FROM claimed c LEFT JOIN documents d ON d.doc_id = c.pmcid LEFT JOIN article o ON o.pmcid = c.pmcid AND o.section = c.section LEFT JOIN g USING (span_id)),
t AS (SELECT *, CASE WHEN NOT known THEN 'MISSING_FILE' WHEN own IS NULL THEN 'NO_SUCH_SECTION' WHEN sec IS NULL THEN 'NO_QUOTE_TO_VERIFY' WHEN sec = section AND a = 0 AND z = char_end THEN 'OK' WHEN s = 'absent' THEN 'REFUSED_FIX' ELSE 'FIXED' END AS status FROM r)
SELECT span_id, status, CASE WHEN status = 'NO_QUOTE_TO_VERIFY' THEN fits END AS in_range, CASE WHEN status IN ('OK', 'FIXED', 'REFUSED_FIX') THEN s WHEN status = 'NO_QUOTE_TO_VERIFY' AND fits THEN {_subject("substr(own, 1, char_end)")} END AS subject,
  CASE WHEN status = 'FIXED' THEN sec ELSE section END AS new_section, CASE WHEN status = 'FIXED' THEN a ELSE 0 END AS new_start, CASE WHEN status = 'FIXED' THEN z ELSE char_end END AS new_end FROM t""")
def verify_span_statuses(spark: S, sf: str) -> D:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pmcid"))
    out = verification.span_statuses(claimed(spark, sf), articles(spark, sf), d)
    return out.select("span_id", "status", "in_range", "subject", "new_section", "new_start", "new_end")


# --- numbers: an event claims its value, or the start of a document, and cites two spans of documents ---
_drift = f"""{_article}, n AS (SELECT count(*) AS n FROM documents), k AS (SELECT event_id, user_id, value, event_id % (n + 5) AS p FROM events, n),
c AS (SELECT k.event_id, event_id % 7 = 0 AS neg, CASE event_id % 4 WHEN 0 THEN 'no number' WHEN 1 THEN coalesce(substr(d.text, 1, 200), '') ELSE format('{{:.2f}} and {{}}', value, user_id) END AS claim, p, event_id % 9 = 0 AS none FROM k LEFT JOIN documents d ON d.doc_id = p),
s AS (SELECT event_id, 0 AS ord, p AS pmcid, 'abstract' AS section, 40 AS z FROM c WHERE NOT none UNION ALL SELECT event_id, 1, p, 'body', 200 FROM c WHERE NOT none),
t AS (SELECT s.event_id, string_agg(substr(a.text, 1, z), chr(10) ORDER BY ord) FILTER (length(a.text) >= z) AS text FROM s LEFT JOIN article a ON a.pmcid = s.pmcid AND a.section = s.section GROUP BY 1),
m AS (SELECT c.*, t.text, {_numbers('claim')} AS said, {_numbers("coalesce(t.text, '')")} AS seen FROM c LEFT JOIN t USING (event_id)),
f AS (SELECT *, list_filter(said, lambda x: NOT list_contains(seen, x)) AS miss FROM m)
SELECT event_id AS case_id, CASE WHEN neg OR none THEN 'no_spans' WHEN text IS NULL THEN 'span_error' WHEN len(said) = 0 THEN 'no_numeric_claim' WHEN len(miss) > 0 THEN 'missing_numbers' ELSE 'ok' END AS status,
  CASE WHEN NOT (neg OR none) AND text IS NOT NULL THEN array_to_string(list_transform(list_sort(list_transform(miss, lambda x: {{'n': -length(x), 'x': x}})), lambda s: s.x), ' ') ELSE '' END AS missing FROM f"""


@query(f"WITH {_drift}")
def number_drift(spark: S, sf: str) -> D:
    d = table(spark, sf, "documents").select("doc_id", "text")
    n = d.agg((F.count("*") + 5).alias("n"))
    k = F.col("event_id")
    e = table(spark, sf, "events").join(n).select("event_id", "user_id", "value", (k % F.col("n")).alias("p"))
    e = e.join(d, e.p == d.doc_id, "left")
    claim = F.when(k % 4 == 0, "no number").when(k % 4 == 1, F.coalesce(F.substring("text", 1, 200), F.lit(""))).otherwise(F.concat(F.format_string("%.2f", F.col("value")), F.lit(" and "), F.col("user_id").cast("string")))
    span = lambda s, z: F.struct(F.col("p").alias("pmcid"), F.lit(s).alias("section"), F.lit(0).alias("char_start"), F.lit(z).alias("char_end"))
    given = F.when(k % 9 != 0, F.array(span("abstract", 40), span("body", 200))).otherwise(F.array().cast("array<struct<pmcid:bigint,section:string,char_start:int,char_end:int>>"))
    c = e.select(k.alias("case_id"), (k % 7 == 0).alias("is_negative"), claim.alias("claim"), given.alias("gold_spans"))
    out = verification.number_drift(c, articles(spark, sf), d.select(F.col("doc_id").alias("pmcid")))
    return out.select("case_id", "status", F.array_join("missing", " ").alias("missing"))


# --- negatives and hold-outs ---
_negative = "neg AS (SELECT item_id AS case_id, upper(text) AS literal, [item_id % 50, item_id + 7] AS held, CASE WHEN item_id % 4 = 0 THEN 'search' ELSE 'hold_out' END AS construction FROM benchmark), rest AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"


@query(f"""WITH {_negative}, h AS (SELECT case_id, unnest(held) AS p FROM neg), f AS (SELECT case_id, sum((p NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))::INTEGER)::BIGINT AS unregistered, sum((p IN (SELECT doc_id FROM rest))::INTEGER)::BIGINT AS present FROM h GROUP BY 1),
a AS (SELECT case_id, count(doc_id) AS n FROM neg LEFT JOIN rest ON contains(lower(text), lower(literal)) GROUP BY 1)
SELECT case_id, n AS n_articles, unregistered, present, construction = 'hold_out' AS held_out, n + unregistered + present = 0 AND construction = 'hold_out' AS ok FROM neg JOIN a USING (case_id) JOIN f USING (case_id)""")
def negatives_report(spark: S, sf: str) -> D:
    """Whole items as literals, in any letters, against the articles that aren't held out."""
    k = F.col("item_id")
    c = table(spark, sf, "benchmark").select(k.alias("case_id"), F.upper("text").alias("literal"), F.array(k % 50, k + 7).alias("held_out_pmcids"), F.when(k % 4 == 0, "search").otherwise("hold_out").alias("construction"))
    registry = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("pmcid"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pmcid"), "text").join(registry, "pmcid", "left_anti")
    return verification.negatives(c, d, registry)


@query("""WITH reg AS (SELECT o_orderkey AS pmcid, o_custkey AS owner FROM orders WHERE o_orderstatus = 'P'), r AS (SELECT DISTINCT o_custkey + (l_linenumber = 2)::INTEGER AS pair_id, l_orderkey + CASE WHEN l_linenumber = 3 THEN 100000000 ELSE 0 END AS pmcid FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber < 4 AND (o_orderstatus = 'P' OR l_partkey % 3 = 0)),
f AS (SELECT r.*, owner, min(pair_id) OVER (PARTITION BY pmcid) AS first FROM r LEFT JOIN reg USING (pmcid))
SELECT pair_id, pmcid, CASE WHEN owner = pair_id THEN 'skipped' WHEN owner IS NOT NULL THEN 'refused' WHEN pmcid NOT IN (SELECT o_orderkey FROM orders) THEN 'missing' WHEN pair_id = first THEN 'held_out' ELSE 'refused' END AS outcome FROM f""")
def hold_out_requests(spark: S, sf: str) -> D:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    registry = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("pmcid"), F.col("o_custkey").alias("pair_id"))
    n = F.col("l_linenumber")
    r = li.where("l_linenumber < 4").join(o, F.col("o_orderkey") == F.col("l_orderkey")).where("o_orderstatus = 'P' or l_partkey % 3 = 0")
    r = r.select((F.col("o_custkey") + (n == 2).cast("int")).alias("pair_id"), (F.col("l_orderkey") + F.when(n == 3, 100_000_000).otherwise(0)).alias("pmcid"))
    return verification.hold_out(registry, r, o.select(F.col("o_orderkey").alias("pmcid")))


# --- mining reports ---
@query(f"""{_coverage}, w AS (SELECT pair_id, pmcid, CASE WHEN n > 0 THEN 'same_paragraph' ELSE 'doc_level_only' END AS strength, n AS n_same_paragraph_hits, array_to_string(s, ';') AS subject_terms, array_to_string(c, ';') AS condition_terms, coalesce(bs, fs) AS section, coalesce(bo, fo) AS ord FROM cover WHERE len(s) > 0 AND len(c) > 0)
SELECT pair_id, w.pmcid, strength, n_same_paragraph_hits, subject_terms, condition_terms, coalesce(d.source, '') AS title, coalesce(CASE WHEN d.doc_id % 3 > 0 THEN d.lang END, '') AS journal, CASE WHEN d.doc_id IS NULL THEN '' ELSE '2001 Jan' END AS pubdate, w.section, p.char_start, p.char_end, md5(substr(p.text, 1, 400)) AS snippet_md5
FROM w JOIN paragraph p ON p.pmcid = w.pmcid AND p.section = w.section AND p.ord = w.ord LEFT JOIN documents d ON d.doc_id = w.pmcid AND d.doc_id % 5 > 0""")
def coverage_report(spark: S, sf: str) -> D:
    d = table(spark, sf, "documents").where("doc_id % 5 > 0")
    manifest = d.select(F.col("doc_id").alias("pmcid"), F.col("source").alias("title"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("journal"), F.lit("2001 Jan").alias("pubdate"))
    out = mining.coverage_report(paragraphs(spark, sf), SETS, manifest)
    return out.withColumn("snippet_md5", md5("snippet")).drop("snippet")


_rows = f"""{{sent}}, e AS (SELECT pmcid, 'we saw ' || a || ' ( ' || b || ' ) here' AS text, CASE WHEN starts_with(b, 'rs') THEN a ELSE b END AS form_a, CASE WHEN starts_with(b, 'rs') THEN b ELSE a END AS form_b FROM sent WHERE lower(a) <> lower(b) AND NOT (starts_with(a, 'rs') AND starts_with(b, 'rs')))"""
_sort = lambda f: f"CASE WHEN starts_with({f}, 'rs') THEN 'rsid' WHEN left({f}, 2) IN ('c.', 'g.', 'm.') THEN 'cdna' WHEN starts_with({f}, 'p.') THEN 'protein' ELSE 'legacy' END"


def _sent() -> str:
    from .corpus import _sent as sent

    return sent


@query(f"WITH {_rows.format(sent=_sent())} SELECT form_a || '__' || form_b AS pair_id, form_a, form_b, {_sort('form_a')} AS kind_a, {_sort('form_b')} AS kind_b, count(*) AS n_mentions, count(DISTINCT pmcid) AS n_articles, substr(struct_extract(min({{'p': pmcid, 't': text}}), 't'), 1, 200) AS example FROM e GROUP BY form_a, form_b")
def equivalence_report(spark: S, sf: str) -> D:
    return mining.equivalences(sentences(spark, sf))


# sentences that name a gene, two changes and a condition, at distances that the order lines give
_gene = "CASE l_suppkey % 3 WHEN 0 THEN 'BRCA1' WHEN 1 THEN 'TP53' ELSE 'nothing' END"
_cond = "CASE l_linenumber % 3 WHEN 0 THEN 'breast cancer' WHEN 1 THEN 'Ovarian Cancer' ELSE 'good health' END"


@query(f"""WITH s AS (SELECT l_orderkey AS pmcid, l_linenumber AS ord, {_gene} AS gene, l_quantity::INTEGER % 40 AS n, 'c.' || (l_orderkey * 7 + l_linenumber % 2) || 'A>G' AS v, 'c.' || (l_suppkey * 100 + l_orderkey % 100) || '_' || (l_suppkey * 100 + 200) || 'del' AS w, lower({_cond}) AS condition FROM lineitem WHERE l_linenumber % 3 < 2),
m AS (SELECT pmcid, ord, 0 AS i, v AS variant, gene, 1 + 2 * n AS d, condition FROM s UNION ALL SELECT pmcid, ord, 1, w, gene, 1 + 2 * n + length(v) + 4, condition FROM s),
a AS (SELECT *, gene <> 'nothing' AND length(gene) + d <= 60 AS near FROM m), o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY variant, pmcid ORDER BY ord, i, CASE WHEN near THEN gene END NULLS FIRST, CASE WHEN near THEN d ELSE -1 END, condition) = 1), f AS (SELECT *, count(*) OVER (PARTITION BY variant) AS df FROM o)
SELECT variant, CASE WHEN near THEN gene ELSE 'UNKNOWN' END AS gene_hint, (CASE WHEN near THEN d ELSE -1 END)::INTEGER AS gene_distance_chars, condition, df, pmcid FROM f WHERE df <= 3""")
def rare_variants(spark: S, sf: str) -> D:
    gene = F.when(F.col("l_suppkey") % 3 == 0, "BRCA1").when(F.col("l_suppkey") % 3 == 1, "TP53").otherwise("nothing")
    condition = F.when(F.col("l_linenumber") % 3 == 0, "breast cancer").when(F.col("l_linenumber") % 3 == 1, "Ovarian Cancer").otherwise("good health")
    filler = F.repeat(F.lit("x "), F.col("l_quantity").cast("int") % 40)
    text = F.concat(F.lit("In "), gene, F.lit(" "), filler, F.lit("c."), (F.col("l_orderkey") * 7 + F.col("l_linenumber") % 2).cast("string"), F.lit("A>G or c."), (F.col("l_suppkey") * 100 + F.col("l_orderkey") % 100).cast("string"), F.lit("_"), (F.col("l_suppkey") * 100 + 200).cast("string"), F.lit("del with "), condition)
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pmcid"), F.lit("body").alias("section"), F.col("l_linenumber").alias("ord"), text.alias("text"))
    return mining.rare_variants(p, 3)


_cases = f"""{PARA}, {_held}, k AS (SELECT *, form_present AS x, form_absent AS y FROM d WHERE present_df <= 6
  QUALIFY row_number() OVER (PARTITION BY pair_id, pmcid ORDER BY section <> 'abstract', present_df, char_end - char_start, char_start) = 1),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) GROUP BY 1)"""
_g = "CASE WHEN pmcid % 3 > 0 THEN 'gene' || pmcid % 5 END"


@query(f"""WITH {_cases}, c AS (SELECT k.*, coalesce(df.df, 0) AS low FROM k LEFT JOIN df ON df.term = lower(x) WHERE contains(text, x) AND NOT contains(text, y)), s AS (SELECT *, unnest(['matched', 'mismatched']) AS style, unnest([x, y]) AS form FROM c WHERE low <= 60), q AS (SELECT *, concat_ws(' ', {_g}, form, 'variant') AS query FROM s)
SELECT pmcid || ':' || section || ':' || char_start || '#' || style AS query_id, pmcid || ':' || section || ':' || char_start AS case_id, pair_id, style, query, low AS present_min_token_df, 'cdna<->cdna' AS notation_axis,
  round(len(list_intersect(list_distinct({toks('query')}), list_distinct({toks('text')}))) / len(list_distinct({toks('query')}))::DOUBLE, 4) AS lexical_overlap, substr(sha1(text), 1, 12) AS gold_text_sha1 FROM q""")
def identifier_rows(spark: S, sf: str) -> D:
    """Cases from mined candidates, with frequencies looked up in the index."""
    found = mining.one_form_only(raw_paragraphs(spark, sf), word_pairs(spark, sf))
    place = paragraphs(spark, sf).select("pmcid", "section", "ord", "char_start", "char_end")
    gene = F.when(F.col("pmcid") % 3 > 0, F.concat(F.lit("gene"), (F.col("pmcid") % 5).cast("string")))
    c = found.join(place, ["pmcid", "section", "ord"]).withColumn("gene", gene)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pmcid"), F.col("lang").alias("section"), "text")
    return verification.identifier_rows(c, d, d, index.build(documents(spark, sf)).terms)


# --- review ---
_lo, _hi = wilson("holes", "n")
_over = lambda a, b: f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len({a})::DOUBLE END)"
_long = lambda t: f"list_distinct(list_filter(string_split(lower({collapse(t)}), ' '), lambda w: length(w) > 3))"


@query(f"""WITH {bm25(DOCS, ITEMS)}, {topk(5)}, {_gold}, h AS (SELECT query_id, bool_or((query_id, chunk_ord) NOT IN (SELECT item_id, pmcid FROM gold) AND {_over(_long('b.text'), _long('d.text'))} >= 0.35) AS hole FROM run JOIN documents d ON d.doc_id = chunk_ord JOIN benchmark b ON b.item_id = query_id WHERE query_id IN (SELECT item_id FROM gold) GROUP BY 1),
t AS (SELECT count(*) AS n, sum(hole::INTEGER)::BIGINT AS holes FROM h) SELECT n, holes, round(holes / n::DOUBLE, 4) AS value, round({_lo}, 4) AS ci_low, round({_hi}, 4) AS ci_high FROM t""")
def hole_interval(spark: S, sf: str) -> D:
    """Hits that aren't gold and still answer, for queries whose gold the index holds."""
    gold = gold_spans(spark, sf).select(F.col("item_id").alias("query_id"), F.col("pmcid").alias("doc_id")).distinct()
    hits = found_texts(spark, sf, 5).join(gold.select("query_id").distinct(), "query_id", "left_semi")
    hits = hits.join(gold.withColumn("gold", F.lit(True)), ["query_id", "doc_id"], "left").withColumn("gold", F.coalesce("gold", F.lit(False)))
    out = service.hole_rate(hits, labels.word_overlap(F.col("query"), F.col("text")) >= 0.35)
    return out.select("n", "holes", *[F.round(c, 4).alias(c) for c in ("value", "ci_low", "ci_high")])


_wlo, _whi = wilson("wrong", "filled")


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, max(CASE (l_partkey % 5)::INTEGER WHEN 0 THEN 'wrong' WHEN 1 THEN 'unsure' WHEN 2 THEN '' ELSE 'valid' END) AS v FROM lineitem WHERE l_linenumber <> 4 GROUP BY ALL HAVING count(*) = 1),
t AS (SELECT count(*) AS cases, sum((v = 'valid')::INTEGER)::BIGINT AS valid, sum((v = 'wrong')::INTEGER)::BIGINT AS wrong, sum((v = 'unsure')::INTEGER)::BIGINT AS unsure FROM v), f AS (SELECT *, valid + wrong + unsure AS filled FROM t)
SELECT cases, valid, wrong, unsure, cases - filled AS unfilled, round(wrong / filled::DOUBLE, 4) AS wrong_rate, round({_wlo}, 4) AS ci_low, round({_whi}, 4) AS ci_high FROM f""")
def worksheet_error_rate(spark: S, sf: str) -> D:
    """Filled-in worksheets: a heading, a note and a verdict for each line of an order; the fourth has none."""
    li = table(spark, sf, "lineitem")
    once = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("k"), F.max("l_partkey").alias("l_partkey")).where("k = 1")
    k = F.col("l_partkey") % 5
    said = F.when(k == 0, "**wrong** (see note)").when(k == 1, "`Unsure`, maybe").when(k == 2, "___").otherwise("VALID")
    verdict = F.when(F.col("l_linenumber") != 4, F.concat(F.lit("verdict: "), said))
    lines = F.array(F.concat(F.lit("## "), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")), F.lit("- note: verdict to come"), verdict)
    rows = once.select(F.col("l_orderkey").alias("sheet"), "l_linenumber", F.posexplode(F.array_compact(lines)).alias("i", "line")).select("sheet", (F.col("l_linenumber") * 10 + F.col("i")).alias("line_no"), "line")
    heading = F.when(F.startswith("line", F.lit("## ")), F.substring("line", 4, 1000))
    given = F.when(F.startswith("line", F.lit("verdict: ")), F.coalesce(T.parse_verdict(F.substring("line", 10, 1000)), F.lit("")))
    out = service.worksheet_error_rate(service.worksheet_verdicts(rows, heading, given))
    return out.withColumns({c: F.round(c, 4) for c in ("wrong_rate", "ci_low", "ci_high")})


_kinds = "['match', 'match', 'summary', 'match', 'error', 'match', 'match', 'match', 'match', 'summary', 'match']"


@query(f"""WITH l AS (SELECT user_id AS stream, event_id AS seq, {_kinds}[event_id % 11 + 1] AS kind FROM events), f AS (SELECT *, min(seq) FILTER (kind = 'summary') OVER (PARTITION BY stream) AS first FROM l)
SELECT stream, sum(coalesce(seq > first, false)::INTEGER)::BIGINT AS after_summary, bool_or(kind = 'error') AS failed, count(*) FILTER (kind = 'summary') AS summaries FROM f GROUP BY 1""")
def protocol_faults(spark: S, sf: str) -> D:
    """Everything after a stream's first summary, not only the line right after it."""
    kinds = ["match", "match", "summary", "match", "error", "match", "match", "match", "match", "summary", "match"]
    kind = F.get(F.array(*map(F.lit, kinds)), (F.col("event_id") % 11).cast("int"))
    return service.protocol_faults(table(spark, sf, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), kind.alias("kind")))


# --- contexts of the answering arms ---
@query(f"""WITH {bm25(DOCS, ITEMS)}, {topk(8)}, {_gold}, e AS (SELECT query_id, 'bm25' AS arm, rank, chunk_ord AS pmcid, 'doc' AS section, text FROM run JOIN documents ON doc_id = chunk_ord
  UNION ALL SELECT item_id, 'oracle', row_number() OVER (PARTITION BY item_id ORDER BY g.pmcid, char_start), g.pmcid, g.section, substr(d.text, char_start + 1, char_end - char_start) FROM gold g JOIN documents d ON d.doc_id = g.pmcid),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, arm ORDER BY rank) AS i FROM e), x AS (SELECT query_id, arm, count(*) AS n_excerpts, string_agg('[' || i || '] (from ' || pmcid || ', ' || section || ') ' || text, chr(10) || chr(10) ORDER BY i) AS context FROM n GROUP BY ALL)
SELECT item_id AS query_id, arm, coalesce(n_excerpts, 0) AS n_excerpts, md5(coalesce(context, '')) AS context_md5 FROM (SELECT item_id, unnest(['none', 'bm25', 'oracle']) AS arm FROM benchmark) LEFT JOIN x ON x.query_id = item_id AND x.arm = arm.arm""".replace("x.arm = arm.arm", "x.arm = a.arm").replace("FROM benchmark) LEFT JOIN x", "FROM benchmark) a LEFT JOIN x").replace("SELECT item_id AS query_id, arm, coalesce", "SELECT item_id AS query_id, a.arm, coalesce"))
def baseline_excerpts(spark: S, sf: str) -> D:
    """What each arm is shown: nothing, the hits of a search, or the gold spans."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pmcid"), F.col("lang").alias("section"), "text")
    bm = found_texts(spark, sf, 8).select("query_id", "rank", F.col("doc_id").alias("pmcid"), F.lit("doc").alias("section"), "text")
    g = spans.dereference(gold_spans(spark, sf), d, d).where("error is null")
    oracle = g.select(F.col("item_id").alias("query_id"), F.struct("pmcid", "char_start").alias("rank"), "pmcid", "section", F.col("span_text").alias("text"))
    arms = [verification.excerpts(x).withColumn("arm", F.lit(a)) for a, x in (("bm25", bm), ("oracle", oracle))]
    q = questions(spark, sf).select("query_id", F.explode(F.array(*map(F.lit, ("none", "bm25", "oracle")))).alias("arm"))
    out = q.join(arms[0].unionByName(arms[1]), ["query_id", "arm"], "left")
    return out.select("query_id", "arm", F.coalesce("n_excerpts", F.lit(0)).alias("n_excerpts"), md5(F.coalesce("context", F.lit(""))).alias("context_md5"))


# --- a benchmark as three files ---
@query("""WITH j AS (SELECT DISTINCT item_id AS q, doc_id AS d FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)), n AS (SELECT q, count(*) AS n FROM j GROUP BY 1)
SELECT item_id::VARCHAR AS query_id, coalesce(n, 0) AS n_relevant, md5(text) AS query_md5 FROM benchmark LEFT JOIN n ON q = item_id""")
def beir_bundle(spark: S, sf: str) -> D:
    """Writes corpus, queries and judgments, loads them as one dataset and joins all three."""
    path = files.shared_folder(spark)
    b = table(spark, sf, "benchmark")
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("title"))
    d.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/corpus.jsonl")
    b.select(F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), "text")).alias("value")).write.text(f"{path}/queries.jsonl")
    judged = gold_spans(spark, sf).select(F.concat_ws("\t", F.col("item_id").cast("string"), F.lit("0"), F.col("pmcid").cast("string"), F.lit("1")).alias("value"))
    judged.distinct().write.text(f"{path}/qrels.txt")
    s = files.dataset(spark, path)
    n = s.relevant().join(s.documents.select(F.col("id").alias("doc_id")), "doc_id").groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    return s.queries.join(n, s.queries.id == n.query_id, "left").select(F.col("id").alias("query_id"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"), md5("text").alias("query_md5"))


#: Earlier names of queries that now run the full operator.
EARLIER = {
    "numeric_drift": number_drift,
    "identifier_cases": identifier_rows,
    "hole_rate": hole_interval,
    "worksheet_summary": worksheet_error_rate,
    "stream_protocol_check": protocol_faults,
    "baseline_contexts": baseline_excerpts,
    "verify_spans": verify_span_statuses,
    "recall_by_overlap": recall_by_hit_overlap,
}
for _name, _full in EARLIER.items():
    query(ORACLES[_full.__name__], _name)(_full)
