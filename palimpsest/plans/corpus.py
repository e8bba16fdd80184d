"""Mining, case construction and verification over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import building, cases, index, mining, spans, verification
from ..session import shared
from .base import DOCS, ITEMS, ORACLES, PARA, bm25, collapse, documents, paragraphs, query, questions, raw_paragraphs, table, topk, toks
from .retrieval import _gold
from .retrieval import gold_spans

S, D = SparkSession, DataFrame

SETS = [("en-the", ["the", "of the"], ["and", "with"]), ("fr-de", ["de", "des"], ["que"]), ("de-der", ["der"], ["und", "von der"]), ("none", ["zzzz"], ["the"])]


W, E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _cover(where: str) -> str:
    parts = []
    for p, s, c in SETS:
        # RE2 knows word ends of ASCII only, so separators are spelt out, and doubled so that neighbours may share one
        alt = lambda ts: f"{W}(" + "|".join(t.replace(" ", "  ") for t in sorted(set(ts), key=lambda t: (-len(t), t))) + f"){E}"
        got = lambda ts: f"list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?i){alt(ts)}', 1), lambda m: replace(m, '  ', ' ')))"
        parts.append(f"SELECT '{p}' AS pair_id, pmcid, section, ord, {got(s)} AS s, {got(c)} AS c FROM paragraph")
    return " UNION ALL ".join(parts)


_coverage = f"""WITH {PARA}, h AS ({_cover("")}), k AS (SELECT *, len(s) > 0 AND len(c) > 0 AS b FROM h),
cover AS (SELECT pair_id, pmcid, sum(b::INTEGER)::BIGINT AS n, arg_min(section, ord) FILTER (b) AS bs, min(ord) FILTER (b) AS bo, arg_min(section, ord) FILTER (len(s) > 0) AS fs, min(ord) FILTER (len(s) > 0) AS fo, list_sort(list_distinct(flatten(list(s)))) AS s, list_sort(list_distinct(flatten(list(c)))) AS c FROM k GROUP BY ALL)"""


@query(f"{_coverage} SELECT pair_id, pmcid, CASE WHEN n > 0 THEN 'same_paragraph' ELSE 'doc_level_only' END AS strength, n AS n_same_paragraph_hits, array_to_string(s, ';') AS subject_terms, array_to_string(c, ';') AS condition_terms, coalesce(bs, fs) AS section, coalesce(bo, fo)::INTEGER AS ord FROM cover WHERE len(s) > 0 AND len(c) > 0")
def find_coverage(spark: S, sf: str) -> D:
    return mining.coverage(raw_paragraphs(spark, sf), SETS)


@query(f"{_coverage} SELECT pair_id, sum((n > 0)::INTEGER)::BIGINT AS same_paragraph, sum((n = 0)::INTEGER)::BIGINT AS doc_level_only, count(*) > 20 AS broad FROM cover WHERE len(s) > 0 AND len(c) > 0 GROUP BY 1")
def coverage_summary(spark: S, sf: str) -> D:
    c = mining.coverage(raw_paragraphs(spark, sf), SETS)
    same = (F.col("strength") == "same_paragraph").cast("long")
    return c.groupBy("pair_id").agg(F.sum(same).alias("same_paragraph"), F.sum(1 - same).alias("doc_level_only"), (F.count("*") > 20).alias("broad"))


_NAME = mining.NAME.replace("(?:", "(")
# names of variants made of line items, in sentences "A (B)"
_form = lambda n: f"CASE ({n}) % 4 WHEN 0 THEN 'rs' || (l_partkey + 100) WHEN 1 THEN 'c.' || l_partkey || 'A>G' WHEN 2 THEN 'p.Arg' || l_partkey ELSE (l_partkey % 900 + 100) || 'delAG' END"
_sent = f"sent AS (SELECT l_orderkey AS pmcid, {_form('l_linenumber')} AS a, {_form('l_suppkey')} AS b FROM lineitem)"


def sentences(spark: S, sf: str) -> D:
    def form(n):
        k = F.col("l_partkey")
        return F.when(n % 4 == 0, F.concat(F.lit("rs"), (k + 100).cast("string"))).when(n % 4 == 1, F.concat(F.lit("c."), k.cast("string"), F.lit("A>G"))).when(n % 4 == 2, F.concat(F.lit("p.Arg"), k.cast("string"))).otherwise(F.concat((k % 900 + 100).cast("string"), F.lit("delAG")))

    a, b = form(F.col("l_linenumber")), form(F.col("l_suppkey"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pmcid"), F.concat(F.lit("we saw "), a, F.lit(" ( "), b, F.lit(" ) here")).alias("text"))


@query(f"""WITH {_sent}, e AS (SELECT pmcid, CASE WHEN starts_with(b, 'rs') THEN a ELSE b END AS form_a, CASE WHEN starts_with(b, 'rs') THEN b ELSE a END AS form_b FROM sent WHERE lower(a) <> lower(b) AND NOT (starts_with(a, 'rs') AND starts_with(b, 'rs')))
SELECT form_a || '__' || form_b AS pair_id, form_a, form_b, count(*) AS n_mentions, count(DISTINCT pmcid) AS n_articles FROM e GROUP BY ALL""")
def mine_pairs(spark: S, sf: str) -> D:
    return mining.equivalences(sentences(spark, sf)).select("pair_id", "form_a", "form_b", "n_mentions", "n_articles")


# a pair of an item's longer words, as the item spells them; they stand in a text as whole runs of letters
_runs = lambda x: f"regexp_extract_all({x}, '[A-Za-z0-9]+')"
_twin = "SELECT 'p' || item_id AS pair_id, w[1] AS form_a, w[2] AS form_b FROM (SELECT item_id, list_sort(list_distinct(list_filter(" + _runs("text") + ", lambda t: length(t) > 9))) AS w FROM benchmark) WHERE len(w) > 1"
_held = f"""pair AS ({_twin}), p AS (SELECT *, list_distinct({_runs("text")}) AS f FROM paragraph WHERE len({toks("text")}) BETWEEN 25 AND 400),
h AS (SELECT pair_id, CASE WHEN list_contains(f, form_a) THEN form_a ELSE form_b END AS form_present, CASE WHEN list_contains(f, form_a) THEN form_b ELSE form_a END AS form_absent, p.*
  FROM p JOIN pair ON list_contains(f, form_a) <> list_contains(f, form_b)),
d AS (SELECT *, count(*) OVER (PARTITION BY form_present) AS present_df FROM h)"""


def word_pairs(spark: S, sf: str) -> D:
    words = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 9)))
    pairs = table(spark, sf, "benchmark").select(F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("pair_id"), words.alias("w")).where("size(w) > 1")
    return pairs.select("pair_id", F.get("w", F.lit(0)).alias("form_a"), F.get("w", F.lit(1)).alias("form_b"))


@query(f"WITH {PARA}, {_held} SELECT pair_id, form_present, form_absent, pmcid, section, ord::INTEGER AS ord, present_df FROM d WHERE present_df <= 6")
def mine_candidates(spark: S, sf: str) -> D:
    return mining.one_form_only(raw_paragraphs(spark, sf), word_pairs(spark, sf))


# case reports of an order: each line names a change by one of its two names, with signs around it
_named = """line AS (SELECT l_orderkey AS pmcid, l_linenumber AS n, (l_partkey * 7 + l_suppkey * 13) % 4000 AS k, l_quantity::INTEGER AS q FROM lineitem),
named AS (SELECT pmcid, n, CASE WHEN (q + n) % 5 < 3 THEN 'c.' || k || 'A>G' ELSE (k + 100) || 'delAG' END AS form, q FROM line),
report AS (SELECT pmcid, string_agg('In patient ' || n || ' we found (' || form || '), which the family shares,', ' ' ORDER BY n, form) AS text, list(form) AS f, count(*) AS lines FROM named GROUP BY pmcid),
pair AS (SELECT 'c.' || k || 'A>G__' || (k + 100) || 'delAG' AS pair_id, 'c.' || k || 'A>G' AS form_a, (k + 100) || 'delAG' AS form_b, count(DISTINCT pmcid) AS n_articles FROM line GROUP BY k)"""


@query(f"""WITH {_named}, h AS (SELECT pair_id, CASE WHEN list_contains(f, form_a) THEN form_a ELSE form_b END AS form_present, CASE WHEN list_contains(f, form_a) THEN form_b ELSE form_a END AS form_absent, pmcid
  FROM (SELECT DISTINCT pmcid, f, unnest(f) AS x FROM report WHERE lines >= 3) JOIN pair ON (x = form_a OR x = form_b) AND list_contains(f, form_a) <> list_contains(f, form_b) WHERE n_articles <= 12),
u AS (SELECT DISTINCT * FROM h), d AS (SELECT *, count(*) OVER (PARTITION BY form_present) AS present_df FROM u) SELECT pair_id, form_present, form_absent, pmcid, present_df FROM d WHERE present_df <= 6""")
def mine_named_candidates(spark: S, sf: str) -> D:
    """Changes in coding notation against their legacy names: signs, capitals and digits at the edges."""
    li = table(spark, sf, "lineitem")
    k, q, n = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 4000, F.col("l_quantity").cast("int"), F.col("l_linenumber")
    coding, legacy = F.concat(F.lit("c."), k.cast("string"), F.lit("A>G")), F.concat((k + 100).cast("string"), F.lit("delAG"))
    form = F.when((q + n) % 5 < 3, coding).otherwise(legacy)
    said = F.concat(F.lit("In patient "), n.cast("string"), F.lit(" we found ("), form, F.lit("), which the family shares,"))
    lines = F.array_sort(F.collect_list(F.struct(n.alias("n"), form.alias("f"), said.alias("s"))))
    reports = li.groupBy(F.col("l_orderkey").alias("pmcid")).agg(F.array_join(F.transform(lines, lambda x: x["s"]), " ").alias("text"))
    pairs = li.groupBy(coding.alias("form_a"), legacy.alias("form_b")).agg(F.count_distinct("l_orderkey").alias("n_articles"))
    pairs = pairs.withColumn("pair_id", F.concat_ws("__", "form_a", "form_b"))
    found = mining.one_form_only(reports.select("pmcid", F.lit("body").alias("section"), F.lit(0).alias("ord"), "text"), pairs)
    return found.select("pair_id", "form_present", "form_absent", "pmcid", "present_df")


# a set for each item: one long word of it as subject, all its short ones as conditions
_letters = lambda x: f"list_distinct(list_filter(regexp_split_to_array(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> ''))"
_item_sets = f"item_set AS (SELECT 'b' || item_id AS pair_id, list_filter(w, lambda x: length(x) > 9)[1:3] AS s, list_filter(w, lambda x: length(x) BETWEEN 4 AND 6) AS c FROM (SELECT item_id, list_sort({_letters('lower(text)')}) AS w FROM benchmark))"


@query(f"""WITH {PARA}, {_item_sets}, words AS (SELECT pmcid, section, ord, unnest({_letters('text')}) AS found FROM paragraph),
term AS (SELECT pair_id, 's' AS kind, unnest(s) AS term FROM item_set UNION ALL SELECT pair_id, 'c', unnest(c) FROM item_set),
h AS (SELECT pair_id, pmcid, section, ord, list(DISTINCT found) FILTER (kind = 's') AS s, list(DISTINCT found) FILTER (kind = 'c') AS c FROM words JOIN term ON lower(found) = term GROUP BY ALL),
k AS (SELECT pair_id, pmcid, coalesce(s, []) AS s, coalesce(c, []) AS c, s IS NOT NULL AND c IS NOT NULL AS b FROM h),
cover AS (SELECT pair_id, pmcid, sum(b::INTEGER)::BIGINT AS n, list_sort(list_distinct(flatten(list(s)))) AS s, list_sort(list_distinct(flatten(list(c)))) AS c FROM k GROUP BY ALL)
SELECT pair_id, pmcid, CASE WHEN n > 0 THEN 'same_paragraph' ELSE 'doc_level_only' END AS strength, n AS n_same_paragraph_hits, array_to_string(s, ';') AS subject_terms, array_to_string(c, ';') AS condition_terms FROM cover WHERE len(s) > 0 AND len(c) > 0""")
def coverage_of_items(spark: S, sf: str) -> D:
    """Coverage of sets that are a table of any length."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")))
    sets = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("pair_id"), words.alias("w"))
    sets = sets.select("pair_id", F.slice(F.filter("w", lambda x: F.length(x) > 9), 1, 3).alias("subjects"), F.filter("w", lambda x: F.length(x).between(4, 6)).alias("conditions"))
    return mining.coverage(raw_paragraphs(spark, sf), sets).select("pair_id", "pmcid", "strength", "n_same_paragraph_hits", "subject_terms", "condition_terms")


_genes = ["The", "of", "And", "with"]


@query(f"""WITH p AS (SELECT doc_id, text, (length(text) * 3 // 5)::BIGINT AS pos FROM documents), w AS (SELECT doc_id, substr(text, greatest(pos - 60, 0) + 1, least(pos, 60)) AS w FROM p),
g AS (SELECT doc_id, w, unnest(range({len(_genes)})) AS i, unnest({_genes}) AS g FROM w),
h AS (SELECT doc_id, i, g, length(regexp_extract(w, '(?s)^(?:.*[^\\p{{L}}\\p{{N}}_])?' || g || '(|[^\\p{{L}}\\p{{N}}_].*)$', 1)) AS d FROM g WHERE regexp_matches(w, '(?s)^(?:.*[^\\p{{L}}\\p{{N}}_])?' || g || '(|[^\\p{{L}}\\p{{N}}_].*)$'))
SELECT w.doc_id, arg_min(g, (d, i)) AS name, coalesce(min(d), -1)::INTEGER AS distance FROM w LEFT JOIN h ON h.doc_id = w.doc_id GROUP BY w.doc_id""")
def nearest_preceding(spark: S, sf: str) -> D:
    d = table(spark, sf, "documents").select("doc_id", "text", F.floor(F.length("text") * 3 / 5).cast("int").alias("at"))
    return mining.nearest_before(d, "text", "at", _genes).select("doc_id", "name", "distance")


@query(f"""WITH t AS (SELECT DISTINCT doc_id, unnest({toks("text")}) AS term FROM documents), d AS (SELECT term, count(*) AS df, min(doc_id) AS first FROM t GROUP BY 1) SELECT term, df, first FROM d WHERE df <= 3""")
def rare_terms(spark: S, sf: str) -> D:
    t = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df"), F.min("doc_id").alias("first")).where("df <= 3")


@query("""WITH s AS (SELECT l_suppkey AS case_id, l_orderkey AS pmcid FROM lineitem), y AS (SELECT o_orderkey AS pmcid, year(o_orderdate)::INTEGER AS year FROM orders WHERE o_orderkey % 3 > 0), m AS (SELECT case_id, min(year) AS year FROM s LEFT JOIN y USING (pmcid) GROUP BY 1)
SELECT case_id, year, CASE WHEN year IS NULL THEN 'unknown' WHEN year < 1995 THEN 'pre' ELSE 'post' END AS stratum FROM m""")
def date_strata(spark: S, sf: str) -> D:
    s = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_orderkey").alias("pmcid"))
    y = table(spark, sf, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("pmcid"), F.year("o_orderdate").alias("year"))
    return cases.strata_by_year(s, y, 1995)


_cases = " ".join(f"WHEN contains(lower(title), '{p}') THEN '{s}'" for p, s in T.TITLE_RULES)


@query(f"WITH {PARA}, c AS (SELECT pmcid, ord::INTEGER AS ord, CASE WHEN regexp_matches(lower(title), '{'|'.join(T.EXCLUDED_TITLES)}') THEN NULL {_cases} ELSE 'body_other' END AS stratum, len({toks('text')})::INTEGER AS n_tokens FROM paragraph) SELECT * FROM c WHERE stratum IS NOT NULL AND n_tokens BETWEEN 50 AND 600")
def candidate_paragraphs(spark: S, sf: str) -> D:
    return cases.candidates(raw_paragraphs(spark, sf)).select("pmcid", "ord", "stratum", "n_tokens")


_df = f"df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) GROUP BY 1)"


@query(f"WITH {_df}, q AS (SELECT DISTINCT item_id, unnest({toks('text')}) AS term FROM benchmark), m AS (SELECT item_id, min(df) AS m FROM q JOIN df USING (term) GROUP BY 1) SELECT item_id AS query_id, coalesce(m, 1073741824) AS rarest_df FROM benchmark LEFT JOIN m USING (item_id)")
def rarest_term_df(spark: S, sf: str) -> D:
    return cases.rarest_df(questions(spark, sf), index.build(documents(spark, sf)).terms)


_PARAS = "SELECT pmcid * 2147483648 + ord AS chunk_ord, text FROM paragraph"
_spec = f"""WITH {PARA}, {bm25(_PARAS, ITEMS)}, {topk(50)}, {_gold}, one AS (SELECT item_id, min((pmcid, section, char_start, char_end)) AS g FROM gold GROUP BY 1),
h AS (SELECT query_id, rank, score, p.pmcid, p.section, p.char_start, p.char_end FROM run JOIN paragraph p ON p.pmcid * 2147483648 + p.ord = chunk_ord),
x AS (SELECT h.*, struct_extract(g, 1) AS gp, h.pmcid = struct_extract(g, 1) AND h.section = struct_extract(g, 2) AND h.char_start < struct_extract(g, 4) AND struct_extract(g, 3) < h.char_end AS is_gold FROM h JOIN one ON item_id = query_id),
a AS (SELECT query_id, max(rank) FILTER (is_gold) AS gold_rank, arg_max(score, rank) FILTER (is_gold) AS gs, coalesce(max(score) FILTER (NOT is_gold AND pmcid <> gp), 0.0) AS other FROM x GROUP BY 1)
SELECT item_id AS query_id, gold_rank::INTEGER AS gold_rank, round(CASE WHEN gs > 0 THEN (gs - greatest(other, 0.0)) / gs ELSE '-Infinity'::DOUBLE END, 6) AS margin FROM benchmark LEFT JOIN a ON query_id = item_id"""


@query(_spec)
def specificity_margin(spark: S, sf: str) -> D:
    p = paragraphs(spark, sf).withColumn("chunk_ord", F.shiftleft("pmcid", 31) + F.col("ord"))
    gold = gold_spans(spark, sf).groupBy(F.col("item_id").alias("query_id")).agg(F.min(F.struct("pmcid", "section", "char_start", "char_end")).alias("g")).select("query_id", "g.*")
    hits = index.search_texts(p.select("chunk_ord", "text"), questions(spark, sf), 50).join(p.select("chunk_ord", "pmcid", "section", "char_start", "char_end"), "chunk_ord")
    return cases.specificity(hits, gold, questions(spark, sf)).select("query_id", "gold_rank", F.round("margin", 6).alias("margin"))


# made cases of all paragraphs; queries are their beginnings, shortened, emptied or repeated
_made = f"""{PARA}, made AS (SELECT pmcid, ord::INTEGER AS ord, text AS paragraph,
  CASE ord % 7 WHEN 0 THEN '' WHEN 1 THEN 'not in it at all' ELSE substr(text, 20, 12 + (ord % 5) * 30) END AS answer,
  CASE ord % 11 WHEN 0 THEN NULL ELSE substr(text, 1, 30 + (ord % 4) * 60)  END AS lexical,
  CASE ord % 13 WHEN 0 THEN substr(text, 1, 30 + (ord % 4) * 60) ELSE 'what did they find about ' || substr(text, 60, 40) END AS paraphrased FROM paragraph)"""


def made(spark: S, sf: str) -> D:
    p = spans.lines(table(spark, sf, "documents").select(F.col("doc_id").alias("pmcid"), F.col("lang").alias("section"), "text"))
    o, t = F.col("ord"), F.col("text")
    start = F.substring(t, F.lit(1), 30 + (o % 4) * 60)
    return p.select("pmcid", "section", "char_start", "char_end", "ord", t.alias("paragraph"), F.when(o % 7 == 0, "").when(o % 7 == 1, "not in it at all").otherwise(F.substring(t, F.lit(20), 12 + (o % 5) * 30)).alias("answer"), F.when(o % 11 != 0, start).alias("lexical"), F.when(o % 13 == 0, start).otherwise(F.concat(F.lit("what did they find about "), F.substring(t, 60, 40))).alias("paraphrased"))


_n = lambda x: f"len({toks(x)})"
_normal = lambda x: collapse(f"translate(lower({x}), '‐‑‒–—−', '------')")
_share = lambda a, b: f"(CASE WHEN len(list_distinct({toks(a)})) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct({toks(a)}), list_distinct({toks(b)}))) / len(list_distinct({toks(a)}))::DOUBLE END)"


@query(f"""WITH {_made} SELECT pmcid, ord, CASE WHEN answer IS NULL OR {collapse('answer')} = '' THEN 'declined' WHEN NOT contains({_normal('paragraph')}, {_normal('answer')}) THEN 'not_verbatim' WHEN {_n('answer')} > 12 THEN 'long_answer'
WHEN lexical IS NULL OR {collapse('lexical')} = '' THEN 'lexical_missing' WHEN paraphrased IS NULL OR {collapse('paraphrased')} = '' THEN 'paraphrased_missing'
WHEN {_n('lexical')} NOT BETWEEN 5 AND 60 THEN 'lexical_length' WHEN {_share('answer', 'lexical')} > 0.7 THEN 'lexical_tautological' WHEN {_n('paraphrased')} NOT BETWEEN 5 AND 60 THEN 'paraphrased_length' WHEN {_share('answer', 'paraphrased')} > 0.7 THEN 'paraphrased_tautological'
WHEN {_normal('lexical')} = {_normal('paraphrased')} THEN 'identical' WHEN list_sort(list_distinct({toks('lexical')})) = list_sort(list_distinct({toks('paraphrased')})) THEN 'anchors_only' END AS reason FROM made""")
def validate_cases(spark: S, sf: str) -> D:
    c = made(spark, sf)
    cols = {k: F.col(k) for k in ("answer", "paragraph", "lexical", "paraphrased")}
    return c.select("pmcid", "ord", cases.rejection(cols | {"anchors": F.array().cast("array<string>")}).alias("reason"))


def ask_of(row: dict) -> dict:
    """What the made cases ask of a paragraph, as a generator would say it; every 17th line has none."""
    o, t = row["ord"], row["text"]
    if o % 17 == 16:
        raise TimeoutError
    start = t[: 30 + (o % 4) * 60]
    answer = "" if o % 7 == 0 else "not in it at all" if o % 7 == 1 else t[19 : 19 + 12 + (o % 5) * 30]
    return {"answer": answer, "lexical": None if o % 11 == 0 else start, "paraphrased": start if o % 13 == 0 else "what did they find about " + t[59:99]}


@query(f"""WITH {_made}, c AS (SELECT pmcid, ord::INTEGER AS ord, pmcid || ':' || ord AS pid, CASE WHEN regexp_matches(lower(title), '{'|'.join(T.EXCLUDED_TITLES)}') THEN NULL {_cases} ELSE 'body_other' END AS stratum FROM paragraph WHERE len({toks('text')}) BETWEEN 50 AND 600),
one AS (SELECT * FROM c WHERE stratum IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pmcid, stratum ORDER BY md5('0:' || pid), pid) = 1),
pool AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('0:' || pid), pid) AS place FROM one QUALIFY place <= 24),
r AS ({{reason}}), v AS (SELECT pool.*, row_number() OVER (PARTITION BY stratum ORDER BY place) AS nth FROM pool JOIN r USING (pmcid, ord) WHERE r.reason IS NULL AND ord % 17 < 16)
SELECT stratum, place::INTEGER AS place, pmcid, ord FROM v WHERE nth <= 8""".replace("{reason}", ORACLES["validate_cases"].split("AS paraphrased FROM paragraph)", 1)[1].strip()))
def quota_build(spark: S, sf: str) -> D:
    """Eight accepted cases a stratum of the paragraphs that may serve, made and checked batch by batch."""
    p = cases.candidates(raw_paragraphs(spark, sf)).withColumn("pid", F.concat_ws(":", F.col("pmcid").cast("string"), F.col("ord").cast("string")))
    make = building.attempting(ask_of, ["ord", "text"], "answer string, lexical string, paraphrased string")

    def attempt(rows: D) -> D:
        made_rows = make(rows)
        cols = {"paragraph": F.col("text"), **{k: F.col(k) for k in ("answer", "lexical", "paraphrased")}, "anchors": F.array().cast("array<string>")}
        return made_rows.withColumn("reason", F.coalesce("failed", cases.rejection(cols)))

    build = building.Build(spark, f"{shared(spark)}/build-{uuid.uuid4().hex}", 8, "pid", "stratum", "pmcid")
    out = build.run(p.select("pid", "pmcid", "ord", "stratum", "text"), attempt).accepted()
    return out.select("stratum", "place", "pmcid", "ord")


@query(f"WITH {_made} SELECT pmcid || ':' || section || ':' || char_start || '-' || char_end AS paragraph_id, style, md5(q) AS query_md5 FROM (SELECT pmcid, section, char_start, char_end, 'lexical' AS style, substr(text, 1, 30 + (ord % 4) * 60) AS q FROM paragraph WHERE ord % 11 > 0 UNION ALL SELECT pmcid, section, char_start, char_end, 'paraphrased', CASE ord % 13 WHEN 0 THEN substr(text, 1, 30 + (ord % 4) * 60) ELSE 'what did they find about ' || substr(text, 60, 40) END FROM paragraph WHERE ord % 11 > 0)")
def paired_rows(spark: S, sf: str) -> D:
    c = made(spark, sf).where("lexical is not null")
    pid = F.concat_ws(":", F.col("pmcid").cast("string"), "section", F.concat_ws("-", F.col("char_start").cast("string"), F.col("char_end").cast("string")))
    two = F.array(F.struct(F.lit("lexical").alias("style"), F.col("lexical").alias("q")), F.struct(F.lit("paraphrased").alias("style"), F.col("paraphrased").alias("q")))
    return c.select(pid.alias("paragraph_id"), F.explode(two).alias("r")).select("paragraph_id", "r.style", F.md5(F.col("r.q").cast("binary")).alias("query_md5"))


def made_set(spark: S, sf: str) -> D:
    """A set with planted faults: wrong digests, missing styles, lost anchors, copied queries."""
    c = made(spark, sf).where("lexical is not null")
    pid = F.concat_ws(":", F.col("pmcid").cast("string"), F.col("ord").cast("string"))
    row = lambda s: F.struct(F.lit(s).alias("style"), F.col(s).alias("query"))
    two = F.when(F.col("pmcid") % 9 == 0, F.array(row("lexical"))).otherwise(F.array(row("lexical"), row("paraphrased")))
    c = c.select("pmcid", "section", "char_start", F.when(F.col("pmcid") % 31 == 0, F.lit(1_000_000)).otherwise(F.col("char_end")).alias("char_end"), "paragraph", pid.alias("paragraph_id"), F.explode(two).alias("r")).select("*", "r.*")
    good = T.digest(F.col("paragraph"))
    return c.select("pmcid", "section", "char_start", "char_end", "paragraph_id", "style", "query", F.concat_ws("#", "paragraph_id", "style").alias("query_id"), F.when(F.col("pmcid") % 17 == 0, "000000000000").otherwise(good).alias("gold_text_sha1"), F.round(T.overlap_share(F.col("query"), F.col("paragraph")) + F.when(F.col("pmcid") % 23 == 0, 0.5).otherwise(0.0), 4).alias("lexical_overlap"), F.when(F.col("pmcid") % 19 == 0, F.array(F.lit("zzz lost"))).otherwise(F.array().cast("array<string>")).alias("anchors"))


_ov = f"round(CASE WHEN len(list_distinct({toks('query')})) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({toks('query')}), list_distinct({toks('paragraph')}))) / len(list_distinct({toks('query')}))::DOUBLE END, 4)"
_set = f"""{PARA}, base AS (SELECT pmcid, section, char_start, CASE WHEN pmcid % 31 = 0 THEN 1000000 ELSE char_end END AS char_end, ord, text AS paragraph, pmcid || ':' || ord AS paragraph_id FROM paragraph WHERE ord % 11 > 0),
rows AS (SELECT *, 'lexical' AS style, substr(paragraph, 1, 30 + (ord % 4) * 60) AS query FROM base UNION ALL SELECT *, 'paraphrased', CASE ord % 13 WHEN 0 THEN substr(paragraph, 1, 30 + (ord % 4) * 60) ELSE 'what did they find about ' || substr(paragraph, 60, 40) END FROM base WHERE pmcid % 9 > 0),
whole AS (SELECT r.*, r.pmcid % 31 = 0 AS broken, {_ov} AS share FROM rows r WHERE pmcid % 9 > 0)"""


@query(f"""WITH {_set} SELECT 'styles' AS "check", paragraph_id AS id, 'lexical' AS detail FROM base WHERE pmcid % 9 = 0
UNION ALL SELECT 'span', paragraph_id, 'out_of_range' FROM whole WHERE broken AND style = 'lexical'
UNION ALL SELECT 'digest', paragraph_id, substr(sha1(paragraph), 1, 12) FROM whole WHERE NOT broken AND style = 'lexical' AND pmcid % 17 = 0
UNION ALL SELECT 'anchor', paragraph_id, 'zzz lost' FROM whole WHERE NOT broken AND style = 'lexical' AND pmcid % 19 = 0
UNION ALL SELECT 'overlap', paragraph_id || '#' || style, format('{{:.4f}}', share) FROM whole WHERE NOT broken AND pmcid % 23 = 0
UNION ALL SELECT 'duplicate_text', {_normal('query')} AS k, count(*)::VARCHAR FROM rows GROUP BY k HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'held_out', pmcid::VARCHAR, '' FROM rows WHERE pmcid IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'concentration', pmcid::VARCHAR, count(*)::VARCHAR FROM base GROUP BY pmcid HAVING count(*) > 3""")
def verify_set(spark: S, sf: str) -> D:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pmcid"), F.col("lang").alias("section"), "text")
    held = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("pmcid"))
    return cases.violations(made_set(spark, sf), d, d, held)


@query("SELECT b.item_id, count(*) FILTER (contains(lower(d.text), lower(b.text))) AS n_articles FROM benchmark b, documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def verify_negatives(spark: S, sf: str) -> D:
    """How many of the remaining articles hold each whole literal."""
    literals = table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("literal"))
    held = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    d = table(spark, sf, "documents").join(held, "doc_id", "left_anti").select(F.col("doc_id").alias("pmcid"), "text")
    hits = verification.literal_hits(literals, d).groupBy("case_id").agg(F.count("*").alias("n"))
    return literals.join(hits, "case_id", "left").select(F.col("case_id").alias("item_id"), F.coalesce("n", F.lit(0)).alias("n_articles"))


@query("SELECT doc_id AS pmcid, lang AS section FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def held_out_view(spark: S, sf: str) -> D:
    held = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf, "documents").join(held, "doc_id", "left_anti").select(F.col("doc_id").alias("pmcid"), F.col("lang").alias("section"))


@query("SELECT DISTINCT l_orderkey AS pmcid FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def held_out_leak(spark: S, sf: str) -> D:
    held = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey").join(held, "l_orderkey", "left_semi").distinct().withColumnRenamed("l_orderkey", "pmcid")


@query("SELECT o_custkey AS pair_id, string_agg(o_orderkey::VARCHAR, ';' ORDER BY o_orderkey) AS pmcids, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def held_out_by_pair(spark: S, sf: str) -> D:
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("pair_id"))
    return o.agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ";").alias("pmcids"), F.count("*").alias("n"))


@query("""WITH old AS (SELECT o_orderkey AS pmcid, o_orderstatus AS status, 't' || o_custkey AS title, 'j' || o_orderkey % 7 AS journal FROM orders WHERE o_orderkey % 4 < 3), new AS (SELECT o_orderkey AS pmcid, 'ok' AS status, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'n' || o_custkey END AS title, NULL::VARCHAR AS journal FROM orders WHERE o_orderkey % 4 > 1)
SELECT n.pmcid, n.status, coalesce(nullif(n.title, ''), o.title) AS title, coalesce(nullif(n.journal, ''), o.journal) AS journal FROM new n LEFT JOIN old o USING (pmcid) UNION ALL SELECT * FROM old WHERE pmcid NOT IN (SELECT pmcid FROM new)""")
def manifest_merge(spark: S, sf: str) -> D:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    old = o.where("o_orderkey % 4 < 3").select(k.alias("pmcid"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("title"), F.concat(F.lit("j"), (k % 7).cast("string")).alias("journal"))
    new = o.where("o_orderkey % 4 > 1").select(k.alias("pmcid"), F.lit("ok").alias("status"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("n"), F.col("o_custkey").cast("string"))).alias("title"), F.lit(None).cast("string").alias("journal"))
    return cases.merged_manifest(new, old)


_two = "two AS (SELECT l_orderkey AS pid, min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY 1 HAVING min(l_partkey) <> max(l_partkey))"
