"""Corpus mining: coverage of term sets, name equivalences, rare names and their attribution."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import forms

#: Fixed value: one variant name: an rsID, an HGVS string or a legacy insertion or deletion.
NAME = r"(?:rs\d{3,}|[cgmp]\.[A-Za-z0-9_>*+\-]{2,30}|\d{2,5}(?:ins|del|dup)[A-Za-z]{0,10})"
NEAR = 60
#: A change in coding notation, and the genes and conditions that a rare one belongs to.
HGVS = (
    r"\bc\.\d+(?:[+-]\d+)?(?:_\d+(?:[+-]\d+)?)?"
    r"(?:[ACGT]+>[ACGT]+|del[ACGT]*|dup[ACGT]*|ins[ACGT]+|delins[ACGT]+)"
)
GENES = ("BRCA1", "BRCA2", "PALB2", "ATM", "CHEK2", "TP53", "RAD51C", "RAD51D", "BRIP1", "BARD1", "PMS2", "MLH1", "MSH2", "MSH6", "MUTYH", "PTEN")
CONDITIONS = ("breast cancer", "ovarian cancer", "pancreatic cancer", "prostate cancer", "colorectal cancer", "endometrial cancer")
SNIPPET = 400


def as_table(paragraphs: DataFrame, term_sets: DataFrame | list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """(pair_id, subjects, conditions) of a list of such rows; a table stays as it is."""
    if isinstance(term_sets, DataFrame):
        return term_sets
    return paragraphs.sparkSession.createDataFrame(term_sets, "pair_id string, subjects array<string>, conditions array<string>")


def coverage(paragraphs: DataFrame, term_sets: DataFrame | list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """(pair_id, pmcid, strength, n_same_paragraph_hits, subject_terms, condition_terms, section, ord).

    term_sets: (pair_id, subjects, conditions), a table or a list of its rows. Texts are scanned once by
    an automaton of all terms; the plan doesn't grow with the sets. A subject or condition without terms
    is never found. Case is ignored; the terms come out as the texts spell them.
    """
    sets = as_table(paragraphs, term_sets)
    side = lambda kind, c: sets.select(F.concat(F.lit(kind), F.col("pair_id")).alias("terms"), F.explode(c).alias("term"))
    terms = side("s", "subjects").unionByName(side("c", "conditions"))
    found = forms.occurrences(paragraphs, ["pmcid", "section", "ord"], terms, once=True)
    found = found.select("pmcid", "section", "ord", F.substring("terms", 1, 1).alias("kind"), F.expr("substring(terms, 2)").alias("pair_id"), "found")
    named = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("found"))).alias(kind)
    hits = found.groupBy("pair_id", "pmcid", "section", "ord").agg(named("s"), named("c"))
    both = (F.size("s") > 0) & (F.size("c") > 0)
    at = F.struct("section", "ord")
    out = hits.groupBy("pair_id", "pmcid").agg(
        F.sum(both.cast("long")).alias("n"),
        F.min(F.when(both, at)).alias("best"),
        F.min(F.when(F.size("s") > 0, at)).alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("c")))).alias("c"),
    ).where("size(s) > 0 and size(c) > 0")
    place = F.coalesce("best", "first")
    return out.select("pair_id", "pmcid", F.when(F.col("n") > 0, "same_paragraph").otherwise("doc_level_only").alias("strength"), F.col("n").alias("n_same_paragraph_hits"), F.array_join("s", ";").alias("subject_terms"), F.array_join("c", ";").alias("condition_terms"), place["section"].alias("section"), place["ord"].alias("ord"))


def coverage_report(paragraphs: DataFrame, term_sets: DataFrame | list[tuple[str, list[str], list[str]]], manifest: DataFrame) -> DataFrame:
    """``coverage`` with the paragraph it points to (char_start, char_end and the first characters) and the
    article's title, journal and pubdate (empty if the manifest lacks it): by pair, those in one paragraph
    first, most hits first. paragraphs: with offsets, as spans.with_offsets gives them."""
    place = paragraphs.select("pmcid", "section", "ord", "char_start", "char_end", F.substring("text", 1, SNIPPET).alias("snippet"))
    rows = coverage(paragraphs, term_sets).join(place, ["pmcid", "section", "ord"]).join(manifest.select("pmcid", "title", "journal", "pubdate"), "pmcid", "left")
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("title", "journal", "pubdate")]
    out = rows.select("pair_id", "pmcid", "strength", "n_same_paragraph_hits", "subject_terms", "condition_terms", *empty, "section", "char_start", "char_end", "snippet")
    return out.orderBy("pair_id", F.col("strength") != "same_paragraph", F.desc("n_same_paragraph_hits"), "pmcid")


def rare_variants(paragraphs: DataFrame, most_df: int = 1, genes: tuple[str, ...] = GENES, conditions: tuple[str, ...] = CONDITIONS) -> DataFrame:
    """(variant, gene_hint, gene_distance_chars, condition, df, pmcid): changes in coding notation in
    paragraphs that name a condition, as far as they stand in ``most_df`` articles at most. The hint is the
    gene that ends nearest before the change (UNKNOWN, -1 without one); of several places in an article the
    first counts. Rarest first, then nearest, those without a gene last."""
    condition = F.coalesce(*[F.when(F.contains(F.lower("text"), F.lit(c)), F.lit(c)) for c in conditions])
    # each part after the first begins with a change, which a second mark ends; an inner explode would have the
    # parts made twice to look for empty ones
    parts = F.split(F.regexp_replace("text", HGVS, "\u0001$0\u0002"), "\u0001")
    p = paragraphs.withColumn("condition", condition).where(F.col("condition").isNotNull() & F.col("text").rlike(HGVS))
    p = p.select("pmcid", "section", "ord", "condition", "text", parts.alias("parts")).select("*", F.posexplode_outer("parts").alias("i", "part")).where("i > 0")
    before = F.replace(F.array_join(F.slice("parts", F.lit(1), F.col("i")), ""), F.lit("\u0002"), F.lit(""))
    p = p.select("pmcid", "section", "ord", "i", "condition", "text", F.length(before).alias("at"), F.substring_index("part", "\u0002", 1).alias("variant"))
    p = nearest_before(p, "text", "at", list(genes))
    first = F.min(F.struct("section", "ord", "i", "name", "distance", "condition"))
    one = p.groupBy("variant", "pmcid").agg(first.alias("f"))
    # counted first: only what is rare meets its places again, so a frequent change fills no task; what is counted
    # is the first place, never null, so that both sides are the same exchange and texts are read once
    df = one.groupBy("variant").agg(F.count("f").alias("df")).where(F.col("df") <= most_df)
    out = one.join(df, "variant")
    out = out.select("variant", F.coalesce("f.name", F.lit("UNKNOWN")).alias("gene_hint"), F.col("f.distance").alias("gene_distance_chars"), F.col("f.condition").alias("condition"), "df", "pmcid")
    return out.orderBy("df", F.when(F.col("gene_distance_chars") >= 0, F.col("gene_distance_chars")).otherwise(1_000_000), "variant", "pmcid")


def equivalences(paragraphs: DataFrame, name: str = NAME) -> DataFrame:
    """(pair_id, form_a, form_b, kind_a, kind_b, n_mentions, n_articles, example): names given as
    ``A (B)``, rsIDs second; the example is the start of the first article's first such paragraph."""
    both = F.regexp_extract_all("text", F.lit(rf"({name})[ \t\n]*\([ \t\n]*({name})[ \t\n]*\)"), F.lit(0))
    example = F.struct("pmcid", F.substring(T.collapse(F.col("text")), 1, 200).alias("text"))
    m = paragraphs.select("pmcid", example.alias("e"), F.explode(both).alias("m")).select("pmcid", "e", F.regexp_extract("m", f"^({name})", 1).alias("x"), F.regexp_extract("m", rf"\([ \t\n]*({name})", 1).alias("y"))
    m = m.where((F.lower("x") != F.lower("y")) & ~(F.startswith("x", F.lit("rs")) & F.startswith("y", F.lit("rs"))))
    second = T.notation_kind(F.col("y")) == "rsid"
    m = m.select("pmcid", "e", F.when(second, F.col("x")).otherwise(F.col("y")).alias("form_a"), F.when(second, F.col("y")).otherwise(F.col("x")).alias("form_b"))
    out = m.groupBy("form_a", "form_b").agg(F.count("*").alias("n_mentions"), F.count_distinct("pmcid").alias("n_articles"), F.min("e")["text"].alias("example"))
    kinds = [T.notation_kind(F.col(c)).alias(k) for c, k in (("form_a", "kind_a"), ("form_b", "kind_b"))]
    return out.select(F.concat_ws("__", "form_a", "form_b").alias("pair_id"), "form_a", "form_b", *kinds, "n_mentions", "n_articles", "example").orderBy(F.desc("n_articles"), F.desc("n_mentions"), "pair_id")


def one_form_only(paragraphs: DataFrame, pairs: DataFrame, least: int = 25, most: int = 400, most_df: int = 6, most_articles: int = 12) -> DataFrame:
    """Paragraphs of 25 to 400 tokens that hold exactly one of a pair's two forms, as long as that form
    stands in few of them: (pair_id, form_present, form_absent, pmcid, section, ord, present_df), the
    rarest forms first, then by pair and article.

    pairs: (pair_id, form_a, form_b) and, where known, n_articles: equivalences of more than
    ``most_articles`` are too common to single out one paragraph and left out. Forms are met as they are
    spelt, with no ASCII letter or digit beside them; where forms overlap, the leftmost and longest counts.
    One automaton of all forms reads each paragraph once; no pair is tested on every paragraph.
    """
    if "n_articles" in pairs.columns:
        pairs = pairs.where(F.col("n_articles") <= most_articles)
    side = lambda a, b: F.struct(F.col(a).alias("form_present"), F.col(b).alias("form_absent"))
    sides = pairs.select("pair_id", F.explode(F.array(side("form_a", "form_b"), side("form_b", "form_a"))).alias("s")).select("pair_id", "s.*")
    p = paragraphs.where(F.size(T.tokens(F.col("text"))).between(least, most))
    terms = sides.select(F.lit("form").alias("terms"), F.col("form_present").alias("term"))
    found = forms.occurrences(p, ["pmcid", "section", "ord"], terms, edges="alnum", ignore_case=False, once=True)
    held = found.select("pmcid", "section", "ord", F.col("found").alias("form_present")).join(sides, "form_present").groupBy("pair_id", "pmcid", "section", "ord")
    held = held.agg(F.count("*").alias("k"), F.min("form_present").alias("form_present"), F.min("form_absent").alias("form_absent")).where("k = 1").drop("k")
    df = held.groupBy("form_present").agg(F.count("*").alias("present_df")).where(F.col("present_df") <= most_df)
    return held.join(df, "form_present").select("pair_id", "form_present", "form_absent", "pmcid", "section", "ord", "present_df").orderBy("present_df", "pair_id", "pmcid", "section", "ord")


def nearest_before(rows: DataFrame, text: str, at: str, names: list[str], reach: int = NEAR) -> DataFrame:
    """Adds name and distance: the listed name that ends closest before position ``at`` within
    ``reach`` characters; null and -1 if none; ties go to the earlier name in the list."""
    window = F.substring(F.col(text), F.greatest(F.col(at) - reach, F.lit(0)) + 1, F.least(F.col(at), F.lit(reach)))
    if names and all(re.fullmatch(r"[A-Za-z0-9_]+", n) for n in names):
        # whole words never overlap: the one that begins last ends last, and one pattern finds it
        last = rf"(?s)^.*\b({'|'.join(dict.fromkeys(names))})\b(.*)$"
        out = rows.withColumn("_w", window).withColumn("name", F.nullif(F.regexp_extract("_w", last, 1), F.lit("")))
        return out.withColumn("distance", F.when(F.col("name").isNotNull(), F.length(F.regexp_extract("_w", last, 2))).otherwise(-1)).drop("_w")
    found = []
    for i, n in enumerate(names):
        # what follows the name's last whole occurrence in the window
        tail = F.regexp_extract(window, rf"(?s)^.*\b{re.escape(n)}\b(.*)$", 1)
        has = window.rlike(rf"\b{re.escape(n)}\b")
        found.append(F.when(has, F.struct(F.length(tail).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n"))))
    best = F.array_min(F.array_compact(F.array(*found)))
    return rows.withColumn("_b", best).withColumn("name", F.col("_b.n")).withColumn("distance", F.coalesce("_b.d", F.lit(-1))).drop("_b")
