"""Verification of gold data against the corpus: spans, numbers, negatives, hold-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import labels, spans

#: Fixed value: where a quote is looked for, in this order.
SECTIONS = ("abstract", "body")


def span_statuses(claimed: DataFrame, sections: DataFrame, documents: DataFrame, fix: bool = True) -> DataFrame:
    """claimed (span_id, pmcid, section, char_start, char_end, note, variant, gene) with status, in_range,
    subject and the span as it should be (new_section, new_start, new_end).

    The first quote of the note that stands in the article, abstract before body, gives the true span: the
    lines that hold it. status: MISSING_FILE, NO_SUCH_SECTION, NO_QUOTE_TO_VERIFY (in_range tells whether
    the claimed span at least lies in its section), OK, REFUSED_FIX (with ``fix``, where the true span
    names neither variant nor gene: the claimed one stays) or FIXED. subject is that of the true span, or
    of the claimed one where no quote was found. A quote meets the sections of its own article only.
    """
    text = sections.select("pmcid", F.col("section").alias("at"), "text")
    order = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("at"))
    quotes = claimed.select("span_id", "pmcid", "variant", "gene", F.posexplode(T.quote_candidates(F.col("note"))).alias("turn", "quote"))
    hits = quotes.join(text, "pmcid").withColumn("f", labels.found(F.col("text"), F.col("quote"))).where("f is not null")
    start, end = T.expand_to_line(F.col("text"), F.col("f.char_start"), F.col("f.char_end"))
    hits = hits.withColumn("a", start.cast("int")).withColumn("z", end.cast("int"))
    subject = labels.subject(F.substring("text", F.col("a") + 1, F.col("z") - F.col("a")), F.col("variant"), F.col("gene"))
    first = hits.groupBy("span_id").agg(F.min(F.struct("turn", order.alias("order"), "at", "a", "z", subject.alias("subject"))).alias("q"))
    own = sections.select("pmcid", "section", F.col("text").alias("_text"))
    known = documents.select("pmcid").distinct().withColumn("_known", F.lit(True))
    rows = claimed.join(known, "pmcid", "left").join(own, ["pmcid", "section"], "left").join(first, "span_id", "left")
    in_range = (F.col("char_start") >= 0) & (F.col("char_start") < F.col("char_end")) & (F.col("char_end") <= F.length("_text"))
    same = (F.col("section") == F.col("q.at")) & (F.col("char_start") == F.col("q.a")) & (F.col("char_end") == F.col("q.z"))
    status = F.when(F.col("_known").isNull(), "MISSING_FILE").when(F.col("_text").isNull(), "NO_SUCH_SECTION").when(F.col("q").isNull(), "NO_QUOTE_TO_VERIFY").when(same, "OK")
    if fix:
        status = status.when(F.col("q.subject") == "absent", "REFUSED_FIX")
    rows = rows.withColumn("status", status.otherwise("FIXED"))
    moved = F.col("status") == "FIXED"
    declared = labels.subject(F.substring("_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")), F.col("variant"), F.col("gene"))
    said = F.when(F.col("status").isin("OK", "FIXED", "REFUSED_FIX"), F.col("q.subject")).when((F.col("status") == "NO_QUOTE_TO_VERIFY") & in_range, declared)
    new = [F.when(moved, F.col(f"q.{q}")).otherwise(F.col(c)).alias(n) for q, c, n in (("at", "section", "new_section"), ("a", "char_start", "new_start"), ("z", "char_end", "new_end"))]
    return rows.select(*claimed.columns, "status", F.when(F.col("status") == "NO_QUOTE_TO_VERIFY", in_range).alias("in_range"), said.alias("subject"), *new)


def number_drift(cases: DataFrame, sections: DataFrame, documents: DataFrame) -> DataFrame:
    """(case_id, status, missing) of cases (case_id, is_negative, claim, gold_spans): numbers of the claim
    that stand in none of the case's spans, longest first. status: no_spans, span_error (no span
    resolves), no_numeric_claim, missing_numbers or ok."""
    one = cases.select("case_id", F.posexplode("gold_spans").alias("ord", "s")).select("case_id", "ord", "s.*")
    text = spans.dereference(one, sections, documents)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("ord", "span_text")))), lambda x: x["span_text"]), "\n")
    per = text.groupBy("case_id").agg(joined.alias("text"), F.count("error").alias("errors"))
    c = cases.join(per, "case_id", "left")
    said = T.numbers_in(F.col("claim"))
    missing = F.array_except(said, T.numbers_in(F.coalesce("text", F.lit(""))))
    ordered = F.transform(F.array_sort(F.transform(missing, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])
    status = F.when(F.col("is_negative") | (F.coalesce(F.size("gold_spans"), F.lit(0)) <= 0), "no_spans").when((F.col("errors") > 0) & (F.col("text") == ""), "span_error").when(F.size(said) == 0, "no_numeric_claim").when(F.size(missing) > 0, "missing_numbers").otherwise("ok")
    return c.select("case_id", status.alias("status"), F.when(status == "missing_numbers", ordered).otherwise(F.array().cast("array<string>")).alias("missing"))


def literal_hits(literals: DataFrame, documents: DataFrame) -> DataFrame:
    """(case_id, pmcid): documents (pmcid, text) that hold a literal (case_id, literal), whatever the case
    of its letters. Literals meet the documents by their rarest inner word, never all with all."""
    items = literals.where("literal is not null").select(F.col("case_id").alias("item_id"), F.lower("literal").alias("item"))
    texts = documents.select("pmcid", F.lit("").alias("section"), F.lower("text").alias("text"))
    return spans.verbatim(items, texts).select(F.col("item_id").alias("case_id"), "pmcid").distinct()


def negatives(cases: DataFrame, documents: DataFrame, registry: DataFrame) -> DataFrame:
    """(case_id, n_articles, unregistered, present, held_out, ok) of negative cases (case_id, literal,
    held_out_pmcids, construction): in how many remaining articles the literal stands, how many of the
    held-out articles the registry lacks, how many the corpus still has, and whether the case was built
    by holding out. Only a case without any fault is ok."""
    found = literal_hits(cases.select("case_id", "literal"), documents).groupBy("case_id").agg(F.count("*").alias("n_articles"))
    held = cases.select("case_id", F.explode("held_out_pmcids").alias("pmcid"))
    listed = registry.select("pmcid").distinct().withColumn("listed", F.lit(True))
    there = documents.select("pmcid").distinct().withColumn("there", F.lit(True))
    per = held.join(listed, "pmcid", "left").join(there, "pmcid", "left").groupBy("case_id").agg(F.sum(F.col("listed").isNull().cast("long")).alias("unregistered"), F.count("there").alias("present"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = cases.join(found, "case_id", "left").join(per, "case_id", "left").select("case_id", zero("n_articles"), zero("unregistered"), zero("present"), F.coalesce(F.col("construction") == "hold_out", F.lit(False)).alias("held_out"))
    return out.withColumn("ok", (F.col("n_articles") + F.col("unregistered") + F.col("present") == 0) & F.col("held_out"))


def hold_out(registry: DataFrame, requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Requests (pair_id, pmcid) with an outcome: skipped (held out for that pair already), refused (held
    out for another pair, also by an earlier request), missing (no such article) or held_out. Add the
    held_out ones to the registry, and nothing changes when the same requests come again."""
    before = registry.select("pmcid", F.col("pair_id").alias("owner"))
    there = documents.select("pmcid").distinct().withColumn("there", F.lit(True))
    r = requests.distinct().join(before, "pmcid", "left").join(there, "pmcid", "left")
    first = F.min("pair_id").over(Window.partitionBy("pmcid"))
    free = F.col("owner").isNull()
    outcome = F.when(~free & (F.col("owner") == F.col("pair_id")), "skipped").when(~free, "refused").when(F.col("there").isNull(), "missing").when(F.col("pair_id") == first, "held_out").otherwise("refused")
    return r.select("pair_id", "pmcid", outcome.alias("outcome"))


def restored(registry: DataFrame, pair_id: Column) -> DataFrame:
    """The registry without a pair's articles, which are thereby back in the corpus."""
    return registry.where(~(F.col("pair_id") == pair_id))


def identifier_rows(candidates: DataFrame, sections: DataFrame, documents: DataFrame, terms: DataFrame, most_df: int = 60) -> DataFrame:
    """(query_id, case_id, pair_id, style, query, present_min_token_df, notation_axis, lexical_overlap,
    gold_text_sha1): two queries a case, by the name that its paragraph uses and by the other.

    candidates: pair_id, pmcid, section, char_start, char_end, form_present, form_absent, present_df, gene.
    Of a pair's paragraphs in one article the abstract's, then the rarest form's, then the shortest counts.
    The present form must stand in the text and the absent one nowhere in it, not even inside another
    word; and the rarest token of the present form must be rare in the corpus (terms: term, df)."""
    rank = [F.col("section") != "abstract", F.col("present_df"), F.col("char_end") - F.col("char_start"), F.col("char_start")]
    best = candidates.withColumn("_r", F.row_number().over(Window.partitionBy("pair_id", "pmcid").orderBy(*rank))).where("_r = 1").drop("_r")
    c = spans.dereference(best, sections, documents).where("error is null")
    c = c.where(F.contains("span_text", F.col("form_present")) & ~F.contains("span_text", F.col("form_absent")))
    token = c.select("pair_id", "pmcid", F.explode(F.array_distinct(T.tokens(F.col("form_present")))).alias("term")).join(terms, "term", "left")
    low = token.groupBy("pair_id", "pmcid").agg(F.min(F.coalesce("df", F.lit(0))).alias("present_min_token_df"))
    c = c.join(low, ["pair_id", "pmcid"]).where(F.col("present_min_token_df") <= most_df)
    case_id = F.concat_ws(":", F.col("pmcid").cast("string"), "section", F.col("char_start").cast("string"))
    styles = F.array(*[F.struct(F.lit(s).alias("style"), F.concat_ws(" ", "gene", f, F.lit("variant")).alias("query")) for s, f in (("matched", "form_present"), ("mismatched", "form_absent"))])
    rows = c.select(case_id.alias("case_id"), "pair_id", "present_min_token_df", T.notation_axis(F.col("form_present"), F.col("form_absent")).alias("notation_axis"), "span_text", F.explode(styles).alias("q")).select("*", "q.*")
    return rows.select(F.concat_ws("#", "case_id", "style").alias("query_id"), "case_id", "pair_id", "style", "query", "present_min_token_df", "notation_axis", F.round(T.overlap_share(F.col("query"), F.col("span_text")), 4).alias("lexical_overlap"), T.digest(F.col("span_text")).alias("gold_text_sha1"))


def excerpts(ranked: DataFrame) -> DataFrame:
    """(query_id, context, n_excerpts) of ranked excerpts (query_id, rank, pmcid, section, text): numbered
    from 1 in order of rank, as a prompt shows them. A query's excerpts are few by their limit."""
    one = F.transform(F.array_sort(F.collect_list(F.struct("rank", "pmcid", "section", "text"))), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] (from "), x["pmcid"].cast("string"), F.lit(", "), x["section"], F.lit(") "), x["text"]))
    return ranked.groupBy("query_id").agg(F.array_join(one, "\n\n").alias("context"), F.count("*").alias("n_excerpts"))
