"""Construction and verification of evaluation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import spans
from .tables import kept, released

# Limits that a case must keep.
QUERY_TOKENS = (5, 60)
ANSWER_TOKENS = 12
ANSWER_IN_QUERY = 0.7
RAREST_DF = 1000
GENERIC_RANK, MARGIN = 5, 0.0
ABSENT = 1 << 30


def candidates(paragraphs: DataFrame, least: int = 50, most: int = 600) -> DataFrame:
    """Paragraphs of 50 to 600 tokens in a section about the science, with their stratum."""
    p = paragraphs.withColumn("stratum", T.classify_section(F.col("section"), F.col("title"))).withColumn("n_tokens", F.size(T.tokens(F.col("text"))))
    return p.where(F.col("stratum").isNotNull() & F.col("n_tokens").between(least, most))


def rarest_df(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, rarest_df): frequency of the query's rarest term that occurs at all; 2^30 if none does."""
    t = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term")).join(terms, "term")
    low = t.groupBy("query_id").agg(F.min("df").alias("df"))
    return queries.select("query_id").join(low, "query_id", "left").select("query_id", F.coalesce("df", F.lit(ABSENT)).alias("rarest_df"))


def specificity(hits: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, gold_rank, margin) from ranked hits (query_id, rank, score, pmcid, section, char_start,
    char_end) and one gold span a query. The margin is how far gold's score, of its last overlapping
    hit, is ahead of the best other article's; -Infinity if gold isn't there or scores nothing."""
    g = gold.select("query_id", F.col("pmcid").alias("g_pmcid"), F.col("section").alias("g_section"), F.col("char_start").alias("g_start"), F.col("char_end").alias("g_end"))
    h = hits.join(g, "query_id")
    is_gold = (F.col("pmcid") == F.col("g_pmcid")) & (F.col("section") == F.col("g_section")) & (F.col("char_start") < F.col("g_end")) & (F.col("g_start") < F.col("char_end"))
    agg = h.groupBy("query_id").agg(F.max(F.when(is_gold, F.struct("rank", "score"))).alias("g"), F.coalesce(F.max(F.when(~is_gold & (F.col("pmcid") != F.col("g_pmcid")), F.col("score"))), F.lit(0.0)).alias("other"))
    out = queries.select("query_id").join(agg, "query_id", "left")
    score = F.col("g.score")
    return out.select("query_id", F.col("g.rank").alias("gold_rank"), F.when(score > 0, (score - F.greatest("other", F.lit(0.0))) / score).otherwise(F.lit(float("-inf"))).alias("margin"))


def rejection(c: dict[str, Column], most_df: int = RAREST_DF) -> Column:
    """The first rule that a case breaks, or null. Keys: answer, paragraph, lexical, paraphrased, anchors
    (those in the paragraph), and optionally lexical_df, paraphrased_df, rank, margin."""
    answer, para = c["answer"], T.normalize(c["paragraph"])
    blank = lambda x: x.isNull() | (T.collapse(x) == "")
    n = lambda x: F.size(T.tokens(x))
    out = F.when(blank(answer), "declined").when(~F.contains(para, T.normalize(answer)), "not_verbatim").when(n(answer) > ANSWER_TOKENS, "long_answer")
    styles = ("lexical", "paraphrased")
    for s in styles:
        out = out.when(blank(c[s]), f"{s}_missing")
    for s in styles:
        out = out.when(~n(c[s]).between(*QUERY_TOKENS), f"{s}_length").when(T.overlap_share(answer, c[s], 1.0) > ANSWER_IN_QUERY, f"{s}_tautological")
        if f"{s}_df" in c:
            out = out.when(c[f"{s}_df"] > most_df, f"{s}_generic")
    if "margin" in c:
        out = out.when(c["rank"].isNull() | (c["rank"] > GENERIC_RANK) | (c["margin"] < MARGIN), "generic")
    known = F.flatten(F.transform(c["anchors"], T.tokens))
    bare = lambda x: F.array_sort(F.array_except(F.array_distinct(T.tokens(x)), known))
    return out.when(T.normalize(c["lexical"]) == T.normalize(c["paraphrased"]), "identical").when(bare(c["lexical"]) == bare(c["paraphrased"]), "anchors_only")


def usable_anchors(anchors: Column, paragraph: Column, most_words: int = 8) -> Column:
    para = T.normalize(paragraph)
    return F.filter(F.coalesce(anchors, F.array().cast("array<string>")), lambda a: a.isNotNull() & (T.collapse(a) != "") & (F.size(F.split(T.collapse(a), " ")) <= most_words) & F.contains(para, T.normalize(a)))


def violations(rows: DataFrame, sections: DataFrame, documents: DataFrame, held_out: DataFrame, most_per_article: int = 3) -> DataFrame:
    """(check, id, detail) for every fault of a set of cases (query_id, paragraph_id, style, query, pmcid,
    section, char_start, char_end, gold_text_sha1, lexical_overlap, anchors); empty for a clean set."""
    rows = kept(rows, "cases", "zstd")  # every check reads them, none makes them again
    released(rows.sparkSession)
    styles = rows.groupBy("paragraph_id").agg(F.array_join(F.array_sort(F.collect_set("style")), ",").alias("styles"))
    bad = [styles.where("styles <> 'lexical,paraphrased'").select(F.lit("styles").alias("check"), F.col("paragraph_id").alias("id"), F.col("styles").alias("detail"))]
    # each value is a column before faults refer to it, so that none is worked out twice
    texts = spans.dereference(rows, sections, documents).withColumn("q", F.array_distinct(T.tokens(F.col("query"))))
    texts = texts.withColumn("share", F.round(T.held_share(F.col("q"), T.tokens(F.col("span_text"))), 4))
    texts = texts.withColumn("sha1", F.when(F.col("style") == "lexical", T.digest(F.col("span_text"))))
    lexical, ok, text = F.col("style") == "lexical", F.col("error").isNull(), F.col("span_text")
    fault = lambda what, key, detail: F.struct(F.lit(what).alias("check"), F.col(key).cast("string").alias("id"), detail.alias("detail"))
    if_so = lambda holds, f: F.when(holds, F.array(f)).otherwise(F.array().cast("array<struct<check:string,id:string,detail:string>>"))
    lost = F.filter(F.coalesce("anchors", F.array().cast("array<string>")), lambda a: lexical & ok & ~F.contains(T.normalize(text), T.normalize(a)))
    faults = F.concat(
        if_so(lexical & ~ok, fault("span", "paragraph_id", F.col("error"))),
        if_so(lexical & ok & ~F.col("gold_text_sha1").eqNullSafe(F.col("sha1")), fault("digest", "paragraph_id", F.col("sha1"))),
        F.transform(lost, lambda a: fault("anchor", "paragraph_id", a)),
        if_so(ok & (F.abs(F.col("share") - F.col("lexical_overlap")) > 1e-9), fault("overlap", "query_id", F.format_number("share", 4))),
    )
    # a paragraph's faults count where both its styles are there; only faults travel to them, where a semi join
    # would be pushed below the texts, and an inner explode would have them worked out twice to look for empty ones
    whole = styles.where("styles = 'lexical,paraphrased'").select("paragraph_id")
    bad.append(texts.select("paragraph_id", faults.alias("faults")).select("paragraph_id", F.explode_outer("faults").alias("f")).where("f is not null").join(whole, "paragraph_id").select("f.*"))
    for what, col in (("duplicate_id", F.col("query_id")), ("duplicate_text", T.normalize(F.col("query")))):
        bad.append(rows.groupBy(col.alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(what).alias("check"), "id", F.col("n").cast("string").alias("detail")))
    bad.append(rows.select("pmcid").distinct().join(held_out.select("pmcid"), "pmcid", "left_semi").select(F.lit("held_out").alias("check"), F.col("pmcid").cast("string").alias("id"), F.lit("").alias("detail")))
    per = rows.where(lexical).groupBy("pmcid").agg(F.count_distinct("paragraph_id").alias("n")).where(F.col("n") > most_per_article)
    bad.append(per.select(F.lit("concentration").alias("check"), F.col("pmcid").cast("string").alias("id"), F.col("n").cast("string").alias("detail")))
    out = bad[0]
    for b in bad[1:]:
        out = out.unionByName(b)
    return out


def merged_manifest(new: DataFrame, old: DataFrame, key: str = "pmcid", kept: tuple[str, ...] = ("title", "journal")) -> DataFrame:
    """New rows replace old ones; old rows without a new one stay; metadata that is missing in a new
    row comes from the old."""
    before = old.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in kept])
    fresh = new.join(before, key, "left")
    fresh = fresh.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) if c in kept else F.col(c) for c in new.columns])
    return fresh.unionByName(old.join(new.select(key), key, "left_anti"))


def strata_by_year(case_spans: DataFrame, years: DataFrame, cutoff: int) -> DataFrame:
    """(case_id, year, stratum): the earliest year of the evidence, before or after the cutoff."""
    y = case_spans.join(years, "pmcid", "left").groupBy("case_id").agg(F.min("year").alias("year"))
    return y.withColumn("stratum", F.when(F.col("year").isNull(), "unknown").when(F.col("year") < cutoff, "pre").otherwise("post"))


def first_match(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
