"""Answers of systems: scoring by property, admission, validation and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rate, wilson
from . import labels

PROPERTIES = ("direction", "strength", "groundedness", "disagreement", "not_found")


def score(cases: DataFrame) -> DataFrame:
    """(case_id and one verdict a property, null where it doesn't apply).

    cases: case_id, is_negative, expected_not_found, has_disagreement, gold_direction, gold_strength,
    disagreement_note, direction, strength, stated_not_found, answer_text, n_claims, n_supported.
    """
    c = F.col
    ordinary = ~c("is_negative")
    grounded = F.when(ordinary | (c("n_claims") > 0), labels.groundedness(c("n_supported"), c("n_claims")))
    return cases.select(
        "case_id",
        F.when(ordinary, labels.grade_direction(c("gold_direction"), c("direction"))).alias("direction"),
        F.when(ordinary, labels.grade_strength(c("gold_strength"), c("strength"))).alias("strength"),
        grounded.alias("groundedness"),
        F.when(ordinary & c("has_disagreement"), labels.disagreement(c("disagreement_note"), c("answer_text"))).alias("disagreement"),
        labels.not_found(c("expected_not_found"), c("stated_not_found"), c("answer_text")).alias("not_found"),
    )


def summary(scores: DataFrame) -> DataFrame:
    """(property, n, pass, partial, fail, pass_rate, ci_low, ci_high); null verdicts don't count."""
    long = scores.unpivot(["case_id"], [p for p in PROPERTIES if p in scores.columns], "property", "verdict").where("verdict is not null")
    n = lambda v: F.sum((F.col("verdict") == v).cast("long")).alias(v)
    out = long.groupBy("property").agg(F.count("*").alias("n"), n("pass"), n("partial"), n("fail"))
    low, high = wilson(F.col("pass"), F.col("n"))
    return out.select("*", F.round(rate(F.col("pass"), F.col("n")), 3).alias("pass_rate"), F.round(low, 3).alias("ci_low"), F.round(high, 3).alias("ci_high"))


def discordant(a: DataFrame, b: DataFrame) -> DataFrame:
    """(property, n, only_a, only_b): paired passes of two runs; cases without a verdict in either drop."""
    x = a.unpivot(["case_id"], list(PROPERTIES), "property", "va").where("va is not null")
    y = b.unpivot(["case_id"], list(PROPERTIES), "property", "vb").where("vb is not null")
    p, q = F.col("va") == "pass", F.col("vb") == "pass"
    return x.join(y, ["case_id", "property"]).groupBy("property").agg(F.count("*").alias("n"), F.sum((p & ~q).cast("long")).alias("only_a"), F.sum((q & ~p).cast("long")).alias("only_b"))


def mapped_claims(claims: DataFrame, excerpts: DataFrame) -> DataFrame:
    """claims (answer_id, claim, excerpt_index) with the excerpt's place; a claim that cites no excerpt
    stays, with an empty place, so that it counts as unsupported. excerpts: answer_id, excerpt_index
    from 1, pmcid, section, char_start, char_end."""
    out = claims.join(excerpts, ["answer_id", "excerpt_index"], "left")
    return out.select("answer_id", "claim", F.coalesce(F.col("pmcid").cast("string"), F.lit("")).alias("cited_pmcid"), F.coalesce("section", F.lit("")).alias("cited_section"), F.coalesce("char_start", F.lit(0)).alias("cited_char_start"), F.coalesce("char_end", F.lit(0)).alias("cited_char_end"))


def invalid(answer: dict[str, Column], n_excerpts: Column) -> Column:
    """Why an answer isn't served, or null. Keys: direction, strength, not_found, answer_text, claims
    (array of struct<text, excerpt_index>)."""
    a, claims = answer, answer["claims"]
    text = F.trim(F.coalesce(a["answer_text"], F.lit("")))
    bad_claim = F.exists(claims, lambda c: c["text"].isNull() | ~F.length(F.trim(c["text"])).between(1, 2000) | c["excerpt_index"].isNull() | (c["excerpt_index"] < 1))
    return (
        F.when(a["direction"].isNull() | ~a["direction"].isin(*labels.DIRECTIONS), "direction")
        .when(a["strength"].isNull() | ~a["strength"].isin(*labels.STRENGTHS), "strength")
        .when(a["not_found"].isNull(), "not_found")
        .when(~F.length(text).between(1, 6000), "answer_text")
        .when(claims.isNull() | (F.size(claims) > 20) | bad_claim, "claims")
        .when(F.exists(claims, lambda c: c["excerpt_index"] > n_excerpts), "unavailable_excerpt")
        .when(a["not_found"] & ((F.size(claims) > 0) | (a["direction"] != "none") | (a["strength"] != "unstated")), "contradiction")
        .when(~a["not_found"] & (F.size(claims) == 0), "no_claims")
    )


def admission(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """One row of counts that a scoring run must meet: cases, held_out, unreviewed, rejected, missing."""
    c = cases.join(answers.select("case_id").distinct().withColumn("_has", F.lit(True)), "case_id", "left")
    n = lambda cond, name: F.coalesce(F.sum(cond.cast("long")), F.lit(0)).alias(name)
    return c.agg(F.count("*").alias("cases"), n(F.col("split") == "held_out", "held_out"), n(F.col("verdict").isNull(), "unreviewed"), n(F.coalesce(F.col("verdict") == "rejected", F.lit(False)), "rejected"), n(F.col("_has").isNull(), "missing"))
