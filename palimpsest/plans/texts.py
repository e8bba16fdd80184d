"""Text functions over whole documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index, labels
from .base import DOCS, ITEMS, PARA, bm25, collapse, documents, query, questions, raw_paragraphs, table, topk, toks

S, D = SparkSession, DataFrame
md5 = lambda c: F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


def docs(spark: S, sf: str) -> D:
    return table(spark, sf, "documents")


@query(f"""SELECT doc_id, md5({collapse("translate(translate(text, 'xqvzj', '‘“–—”'), '‘’“”–—', '''''\"\"--')")}) AS folded_md5 FROM documents""")
def normalize_quotes(spark: S, sf: str) -> D:
    return docs(spark, sf).select("doc_id", md5(T.fold_quotes(F.translate("text", "xqvzj", "‘“–—”"))).alias("folded_md5"))


@query(f"""SELECT doc_id, md5({collapse("translate(lower(translate(text, 'xqv', '‑−—')), '‐‑‒–—−', '------')")}) AS normal_md5 FROM documents""")
def normalize_text(spark: S, sf: str) -> D:
    return docs(spark, sf).select("doc_id", md5(T.normalize(F.translate("text", "xqv", "‑−—"))).alias("normal_md5"))


@query("SELECT doc_id, substr(sha1(text), 1, 12) AS digest FROM documents")
def text_digest(spark: S, sf: str) -> D:
    return docs(spark, sf).select("doc_id", T.digest(F.col("text")).alias("digest"))


_cases = " ".join(f"WHEN contains(lower(title), '{p}') THEN '{s}'" for p, s in T.TITLE_RULES)


@query(f"""WITH {PARA} SELECT pmcid, ord::INTEGER AS ord, CASE WHEN section = 'es' THEN 'abstract' WHEN section = 'de' THEN 'body_other' WHEN regexp_matches(lower(title), '{"|".join(T.EXCLUDED_TITLES)}') THEN NULL {_cases} ELSE 'body_other' END AS stratum FROM paragraph""")
def classify_section(spark: S, sf: str) -> D:
    p = raw_paragraphs(spark, sf)
    section = F.when(F.col("section") == "es", "abstract").otherwise(F.col("section"))
    title = F.when(F.col("section") != "de", F.col("title"))
    return p.select("pmcid", "ord", T.classify_section(section, title).alias("stratum"))


_hits = f"{bm25(DOCS, ITEMS)}, {topk(20)}, p AS (SELECT query_id AS item_id, chunk_ord AS doc_id, q.text AS q, d.text AS t FROM run JOIN benchmark q ON q.item_id = query_id JOIN documents d ON d.doc_id = chunk_ord)"


def item_hits(spark: S, sf: str) -> D:
    """Each item with the whole documents that a search over all of them finds for it."""
    d, q = documents(spark, sf), questions(spark, sf)
    hits = index.search_texts(d, q, 20).join(d, "chunk_ord").join(q, "query_id")
    return hits.select(F.col("query_id").alias("item_id"), F.col("chunk_ord").alias("doc_id"), F.col("query").alias("q"), F.col("text").alias("t"))


_share = lambda a, b, empty: f"round(CASE WHEN len({a}) = 0 THEN {empty} ELSE len(list_intersect({a}, {b})) / len({a})::DOUBLE END, 6) AS share"


@query(f"WITH {_hits}, w AS (SELECT item_id, doc_id, list_distinct({toks('q')}) AS a, list_distinct({toks('t')}) AS b FROM p) SELECT item_id, doc_id, {_share('a', 'b', '0.0')} FROM w")
def lexical_overlap(spark: S, sf: str) -> D:
    return item_hits(spark, sf).select("item_id", "doc_id", F.round(T.overlap_share(F.col("q"), F.col("t")), 6).alias("share"))


@query(f"WITH {_hits}, w AS (SELECT item_id, doc_id, list_distinct({toks('t')}) AS a, list_distinct({toks('q')}) AS b FROM p) SELECT item_id, doc_id, {_share('a', 'b', '1.0')} FROM w")
def answer_share(spark: S, sf: str) -> D:
    return item_hits(spark, sf).select("item_id", "doc_id", F.round(T.overlap_share(F.col("t"), F.col("q"), 1.0), 6).alias("share"))


_plain = "regexp_replace(regexp_replace({x}, '([0-9])[, \\x{{00A0}}\\x{{2009}}\\x{{202F}}]([0-9])', '\\1\\2', 'g'), '([0-9])[, \\x{{00A0}}\\x{{2009}}\\x{{202F}}]([0-9])', '\\1\\2', 'g')"
_numbers = lambda x: f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace({_plain.format(x=x)}, '[^A-Za-z0-9.]', '  ', 'g'), '(^|[^A-Za-z0-9.])([0-9]+(\\.[0-9]+)?)', 2), lambda n: n), lambda n: n <> '')))"


@query(f"SELECT doc_id, array_to_string({_numbers('text')}, ' ') AS numbers FROM documents")
def numbers_in(spark: S, sf: str) -> D:
    return docs(spark, sf).select("doc_id", F.array_join(T.numbers_in(F.col("text")), " ").alias("numbers"))


_form = "CASE l_linenumber % 4 WHEN 0 THEN 'rs' || l_partkey WHEN 1 THEN 'c.' || l_partkey || 'A>G' WHEN 2 THEN 'p.Arg' || l_partkey ELSE l_partkey || 'delAG' END"
_kind = lambda f: f"CASE WHEN starts_with({f}, 'rs') THEN 'rsid' WHEN left({f}, 2) IN ('c.', 'g.', 'm.') THEN 'cdna' WHEN starts_with({f}, 'p.') THEN 'protein' ELSE 'legacy' END"


def forms(spark: S, sf: str) -> D:
    """Variant-like names made from line items; two for each line."""
    def form(n):
        k = F.col("l_partkey").cast("string")
        return F.when(n % 4 == 0, F.concat(F.lit("rs"), k)).when(n % 4 == 1, F.concat(F.lit("c."), k, F.lit("A>G"))).when(n % 4 == 2, F.concat(F.lit("p.Arg"), k)).otherwise(F.concat(k, F.lit("delAG")))

    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", form(F.col("l_linenumber")).alias("form"), form(F.col("l_linenumber") + F.col("l_suppkey")).alias("other"))


@query(f"SELECT l_orderkey, l_linenumber, {_form} AS form, {_kind(_form)} AS kind FROM lineitem")
def notation_kind(spark: S, sf: str) -> D:
    return forms(spark, sf).select("l_orderkey", "l_linenumber", "form", T.notation_kind(F.col("form")).alias("kind"))


@query(f"WITH k AS (SELECT l_orderkey, l_linenumber, {_kind(_form)} AS a, {_kind(_form.replace('l_linenumber', '(l_linenumber + l_suppkey)'))} AS b FROM lineitem), m AS (SELECT l_orderkey, l_linenumber, CASE a WHEN 'legacy' THEN 'cdna' ELSE a END AS a, CASE b WHEN 'legacy' THEN 'cdna' ELSE b END AS b FROM k) SELECT l_orderkey, l_linenumber, least(a, b) || '<->' || greatest(a, b) AS axis FROM m")
def notation_axis(spark: S, sf: str) -> D:
    return forms(spark, sf).select("l_orderkey", "l_linenumber", T.notation_axis(F.col("form"), F.col("other")).alias("axis"))


_said = "['Increase', ' higher ', 'mixed_evidence', 'NO  effect', 'protective', 'none', 'sideways', '']"


def said(column: str = "event_id"):
    words = ["Increase", " higher ", "mixed_evidence", "NO  effect", "protective", "none", "sideways", ""]
    return F.get(F.array(*map(F.lit, words)), (F.col(column) % 8).cast("int"))


_aliases = "{" + ", ".join(f"'{k}': '{v}'" for k, v in labels.DIRECTION_ALIASES.items()) + "}"
_norm = lambda x: f"CASE WHEN {x} IN ('increased', 'decreased', 'none', 'mixed') THEN {x} ELSE coalesce(map_extract_value(MAP {_aliases}, {x}), map_extract_value(MAP {_aliases}, replace({x}, ' ', '_'))) END"
_key = lambda x: collapse(f"replace(lower(trim({x})), '_', ' ')")


@query(f"SELECT event_id, {_norm(_key(f'{_said}[event_id % 8 + 1]'))} AS direction FROM events")
def normalize_label(spark: S, sf: str) -> D:
    return table(spark, sf, "events").select("event_id", labels.direction(said()).alias("direction"))


_marked = "CASE WHEN turn % 3 = 1 AND role = 'assistant' THEN text || ' Could not find it.' ELSE text END"


@query(f"SELECT conv_id, turn, regexp_matches(lower({_marked}), '{'|'.join(T.REFUSALS)}') AS refused FROM conversations")
def refusal_detect(spark: S, sf: str) -> D:
    c = table(spark, sf, "conversations")
    marked = F.when((F.col("turn") % 3 == 1) & (F.col("role") == "assistant"), F.concat("text", F.lit(" Could not find it."))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.refuses(marked).alias("refused"))


@query("""WITH q AS (SELECT doc_id, list_filter(list_filter(string_split(replace(replace(text, ', ', ''''), '. ', ''''), ''''), lambda x, i: i % 2 = 0), lambda x: length(x) >= 15) AS q FROM documents),
u AS (SELECT DISTINCT doc_id, unnest(q) AS x FROM q) SELECT doc_id, count(*) AS n, md5(string_agg(x, '|' ORDER BY -length(x), x)) AS quotes_md5 FROM u GROUP BY doc_id""")
def extract_quotes(spark: S, sf: str) -> D:
    note = F.replace(F.replace("text", F.lit(", "), F.lit("'")), F.lit(". "), F.lit("'"))
    q = docs(spark, sf).select("doc_id", F.array_distinct(T.quoted_blocks(note)).alias("q")).where("size(q) > 0")
    return q.select("doc_id", F.size("q").cast("long").alias("n"), md5(F.array_join("q", "|")).alias("quotes_md5"))


@query("""WITH s AS (SELECT doc_id, text, (doc_id * 37 % length(text))::BIGINT AS a, least(doc_id * 37 % length(text) + 10, length(text)) AS z FROM documents WHERE length(text) > 0)
SELECT doc_id, (a - coalesce(nullif(instr(reverse(substr(text, 1, a)), chr(10)), 0), a + 1) + 1)::INTEGER AS char_start, (CASE WHEN instr(substr(text, z + 1), chr(10)) > 0 THEN z + instr(substr(text, z + 1), chr(10)) - 1 ELSE length(text) END)::INTEGER AS char_end FROM s""")
def expand_to_paragraph(spark: S, sf: str) -> D:
    """One offset a text, anywhere in it; its whole line comes out."""
    d = docs(spark, sf).where("length(text) > 0").withColumn("a", (F.col("doc_id") * 37 % F.length("text")).cast("int"))
    start, end = T.expand_to_line(F.col("text"), F.col("a"), F.least(F.col("a") + 10, F.length("text")))
    return d.select("doc_id", start.cast("int").alias("char_start"), end.cast("int").alias("char_end"))


@query("SELECT doc_id, CASE WHEN contains(text, regexp_replace('c.' || source, '^(c|p)\\.', '')) THEN 'ok' WHEN regexp_matches(lower(text), '\\bthe\\b') THEN 'gene_only' ELSE 'absent' END AS verdict FROM documents")
def subject_check(spark: S, sf: str) -> D:
    d = docs(spark, sf).withColumn("variant", F.concat(F.lit("c."), "source")).withColumn("gene", F.lit("the"))
    return d.select("doc_id", labels.subject(F.col("text"), F.col("variant"), F.col("gene")).alias("verdict"))


_verdicts = "['**Valid**', 'wrong (no)', 'unsure, maybe', 'validity', '`WRONG`', '']"


@query(f"SELECT event_id, nullif(regexp_extract(trim(regexp_replace(lower({_verdicts}[event_id % 6 + 1]), '[*`]', '', 'g')), '^(valid|wrong|unsure)($|[ (,])', 1), '') AS verdict FROM events")
def parse_verdict(spark: S, sf: str) -> D:
    text = F.get(F.array(*map(F.lit, ["**Valid**", "wrong (no)", "unsure, maybe", "validity", "`WRONG`", ""])), (F.col("event_id") % 6).cast("int"))
    return table(spark, sf, "events").select("event_id", T.parse_verdict(text).alias("verdict"))


@query("SELECT conv_id, md5(string_agg('[' || i || '] (from ' || conv_id || ', ' || role || ') ' || text, chr(10) || chr(10) ORDER BY i)) AS excerpts_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations) GROUP BY conv_id")
def format_excerpts(spark: S, sf: str) -> D:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("e"))
    line = F.transform("e", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] (from "), F.col("conv_id").cast("string"), F.lit(", "), x["role"], F.lit(") "), x["text"]))
    return c.select("conv_id", md5(F.array_join(line, "\n\n")).alias("excerpts_md5"))


@query("""WITH price(model, per_in, per_out) AS (VALUES ('view', 0.15::DOUBLE, 0.6::DOUBLE), ('click', 0.59, 0.79)),
u AS (SELECT event_id, event_type AS model, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS n_in, floor(value * 10)::INTEGER AS n_out FROM events)
SELECT event_id, round(n_in / 1e6 * per_in + n_out / 1e6 * per_out, 9) AS usd FROM u LEFT JOIN price USING (model)""")
def llm_cost(spark: S, sf: str) -> D:
    price = spark.sql("SELECT * FROM VALUES ('view', 0.15D, 0.6D), ('click', 0.59D, 0.79D) AS p(event_type, per_in, per_out)")
    e = table(spark, sf, "events").join(price, "event_type", "left")
    used = F.when(F.col("event_id") % 11 != 0, F.col("user_id"))
    return e.select("event_id", F.round(used / 1e6 * F.col("per_in") + F.floor(F.col("value") * 10).cast("int") / 1e6 * F.col("per_out"), 9).alias("usd"))


@query("SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(strftime(o_orderdate, '%d %b %Y'), '(19|20)[0-9][0-9]', 0), '') AS INTEGER) AS year FROM orders")
def pub_year(spark: S, sf: str) -> D:
    return table(spark, sf, "orders").select("o_orderkey", T.pub_year(F.date_format("o_orderdate", "dd MMM yyyy")).alias("year"))


_SEP = r",;\-‐‑‒–—−\s"


@query(f"""WITH m AS (SELECT doc_id, replace(replace(text, ' of ', ' [@, @] '), ' de ', '@ ') AS t FROM documents)
SELECT doc_id, md5({collapse("regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '" + r"\[[" + _SEP + "]*@[" + _SEP + "@]*" + r"\]', '', 'g'), '\([" + _SEP + "]*@[" + _SEP + "@]*" + r"\)', '', 'g'), '[" + _SEP + "@]*@[" + _SEP + "@]*', ' ', 'g'), '" + r"[ \t\n\r\f\x0B]+([.,;:])', '\1', 'g')")}) AS clean_md5 FROM m""")
def strip_citations(spark: S, sf: str) -> D:
    marked = F.replace(F.replace("text", F.lit(" of "), F.lit(" [@, @] ")), F.lit(" de "), F.lit("@ "))
    return docs(spark, sf).select("doc_id", md5(labels.without_citations(marked, "@")).alias("clean_md5"))


@query("""WITH q AS (SELECT doc_id, text, substr(text, 1 + (doc_id * 13 % length(text))::INTEGER, 25) AS quote FROM documents WHERE length(text) > 0)
SELECT doc_id, (instr(text, trim(quote)) - 1)::INTEGER AS char_start, (instr(text, trim(quote)) - 1 + length(trim(quote)))::INTEGER AS char_end FROM q WHERE trim(quote) <> '' AND NOT regexp_matches(quote, '[ \\t\\n\\r\\f\\x0B\\x{00A0}]{2,}|[\\n\\r\\t‘’“”–—]')""")
def find_quote(spark: S, sf: str) -> D:
    """Each whole text is searched for one quote of its own."""
    d = docs(spark, sf).where("length(text) > 0").withColumn("quote", F.substring("text", (1 + F.col("doc_id") * 13 % F.length("text")).cast("int"), F.lit(25)))
    d = d.where((T.trimmed(F.col("quote")) != "") & ~F.col("quote").rlike(r"[ \t\n\r\f\x0B\x{00A0}]{2,}|[\n\r\t‘’“”–—]"))
    return d.select("doc_id", labels.found(F.col("text"), F.col("quote")).alias("f")).select("doc_id", "f.char_start", "f.char_end")


_claims = "regexp_replace(replace(concat_ws('; ', event_type, props), 'user', ' '), '\\b[A-Z]{2,}[0-9]+(/[0-9]+)*\\b', ' ', 'g')"


@query(f"SELECT event_id, {_claims} AS claim FROM events")
def gold_claim_text(spark: S, sf: str) -> D:
    return table(spark, sf, "events").select("event_id", labels.claim_text([F.col("event_type"), F.col("props")], F.lit("user")).alias("claim"))
