"""Scoring of answers, service outcomes and admission gates over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..operators import answers, index, judging, labels, service
from ..streaming import requests
from .base import DOCS, ITEMS, bm25, collapse, documents, query, questions, table, topk, wilson


S, D = SparkSession, DataFrame

# an answer is an order: what it says and what is right follow from its keys
WORDS = ("Increase", "decreased", "no effect", "mixed_evidence", "sideways")
TIERS = ("high", "moderate", "low", "strong", "weak", "unstated", "disputed")
_d = lambda k: "[" + ", ".join(f"'{w}'" for w in WORDS) + f"][({k}) % 5 + 1]"
_t = lambda k: "[" + ", ".join(f"'{w}'" for w in TIERS) + f"][({k}) % 7 + 1]"
_dir = lambda x: f"(CASE lower({x}) WHEN 'increase' THEN 'increased' WHEN 'decreased' THEN 'decreased' WHEN 'no effect' THEN 'none' WHEN 'mixed_evidence' THEN 'mixed' END)"
_str = lambda x: f"(CASE {x} WHEN 'strong' THEN 'high' WHEN 'weak' THEN 'low' ELSE {x} END)"
_tier = lambda x: f"list_position(['low', 'moderate', 'high'], {_str(x)})"
_gd = lambda g, a: f"CASE WHEN {_dir(g)} = {_dir(a)} THEN 'pass' ELSE 'fail' END"
_gs = lambda g, a: f"CASE WHEN {_str(g)} = {_str(a)} THEN 'pass' WHEN abs(nullif({_tier(g)}, 0) - nullif({_tier(a)}, 0)) = 1 THEN 'partial' ELSE 'fail' END"


def word(words, key):
    return F.get(F.array(*map(F.lit, words)), (key % len(words)).cast("int"))




@query(f"SELECT o_orderkey AS case_id, {_gd(_d('o_orderkey'), _d('o_custkey'))} AS verdict FROM orders")
def grade_direction(spark: S, sf: str) -> D:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("case_id"), labels.grade_direction(word(WORDS, F.col("o_orderkey")), word(WORDS, F.col("o_custkey"))).alias("verdict"))


@query(f"SELECT o_orderkey AS case_id, {_gs(_t('o_orderkey'), _t('o_custkey'))} AS verdict FROM orders")
def grade_strength(spark: S, sf: str) -> D:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("case_id"), labels.grade_strength(word(TIERS, F.col("o_orderkey")), word(TIERS, F.col("o_custkey"))).alias("verdict"))


_words = lambda x: f"list_distinct(list_filter(string_split(lower({collapse(x)}), ' '), lambda w: length(w) > 3))"
_over = lambda a, b: f"(CASE WHEN len({_words(a)}) = 0 OR len({_words(b)}) = 0 THEN 0.0 ELSE len(list_intersect({_words(a)}, {_words(b)})) / len({_words(a)})::DOUBLE END)"
# a claim is a turn; it cites the turn before it
_claim = "claim AS (SELECT c.conv_id, c.turn, c.text AS claim, p.text AS span FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 WHERE c.role = 'assistant')"


def claims(spark: S, sf: str) -> D:
    c = table(spark, sf, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("span"))
    return c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("claim")).join(before, ["conv_id", "turn"], "left")


@query(f"WITH {_claim} SELECT conv_id, turn, round({_over('claim', 'coalesce(span, chr(32))')}, 6) AS overlap, span IS NOT NULL AND {_over('claim', 'coalesce(span, chr(32))')} >= 0.35 AS supported FROM claim")
def fake_judge(spark: S, sf: str) -> D:
    span = F.coalesce("span", F.lit(" "))
    return claims(spark, sf).select("conv_id", "turn", F.round(labels.word_overlap(F.col("claim"), span), 6).alias("overlap"), labels.supported(F.col("claim"), F.col("span")).alias("supported"))


@query(f"WITH {_claim} SELECT conv_id, turn, span IS NOT NULL AND {_over('claim', 'coalesce(span, chr(32))')} >= 0.35 AS supported, NULL::VARCHAR AS error, 1::INTEGER AS tries FROM claim")
def judged_claims(spark: S, sf: str) -> D:
    """The deterministic judge by way of the scorer that any other judge would come by."""
    j = judging.judged(claims(spark, sf), judging.GROUNDEDNESS, judging.judge("deterministic"))
    return j.select("conv_id", "turn", (F.col("verdict") == "true").alias("supported"), "error", "tries")


_ground = f"g AS (SELECT conv_id, count(*) AS n, sum((span IS NOT NULL AND {_over('claim', 'coalesce(span, chr(32))')} >= 0.1)::INTEGER) AS s FROM claim GROUP BY 1)"


@query(f"WITH {_claim}, {_ground} SELECT conv_id, n, s::BIGINT AS n_supported, CASE WHEN s / n::DOUBLE >= 0.9 THEN 'pass' WHEN s / n::DOUBLE >= 0.7 THEN 'partial' ELSE 'fail' END AS verdict FROM g")
def groundedness(spark: S, sf: str) -> D:
    ok = F.coalesce(labels.word_overlap(F.col("claim"), F.col("span")) >= 0.1, F.lit(False))
    g = claims(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("n_supported"))
    return g.withColumn("verdict", labels.groundedness(F.col("n_supported"), F.col("n")))


_note = "note AS (SELECT a.conv_id, a.text AS note, b.text || CASE WHEN a.conv_id % 2 = 0 THEN ' results conflict' ELSE '' END AS answer FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND a.turn = 0 AND b.turn = 2)"


@query(f"WITH {_note} SELECT conv_id, CASE WHEN {_over('note', 'answer')} >= 0.25 AND regexp_matches(lower(answer), 'disagree|conflict|contradict|inconsistent|differ') THEN 'pass' WHEN {_over('note', 'answer')} >= 0.15 THEN 'partial' ELSE 'fail' END AS verdict FROM note")
def score_disagreement(spark: S, sf: str) -> D:
    c = table(spark, sf, "conversations")
    a, b = c.where("turn = 0").select("conv_id", F.col("text").alias("note")), c.where("turn = 2").select("conv_id", F.col("text").alias("b"))
    answer = F.concat("b", F.when(F.col("conv_id") % 2 == 0, F.lit(" results conflict")).otherwise(F.lit("")))
    return a.join(b, "conv_id").select("conv_id", labels.disagreement(F.col("note"), answer).alias("verdict"))


_said = "CASE WHEN o_custkey % 4 = 0 THEN 'We could not find it' ELSE 'It is ' || o_orderpriority END"


@query(f"SELECT o_orderkey AS case_id, CASE WHEN (o_orderstatus = 'P' OR regexp_matches(lower({_said}), 'could not find')) = (o_orderkey % 3 = 0) THEN 'pass' ELSE 'fail' END AS verdict FROM orders")
def score_not_found(spark: S, sf: str) -> D:
    o = table(spark, sf, "orders")
    said = F.when(F.col("o_custkey") % 4 == 0, "We could not find it").otherwise(F.concat(F.lit("It is "), "o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("case_id"), labels.not_found(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus") == "P", said).alias("verdict"))


def _scores(shift: int) -> str:
    return f"""SELECT o_orderkey AS case_id, CASE WHEN NOT neg THEN {_gd(_d('o_orderkey'), _d(f'o_custkey + {shift}'))} END AS direction, CASE WHEN NOT neg THEN {_gs(_t('o_orderkey'), _t(f'o_custkey + {shift}'))} END AS strength,
  CASE WHEN NOT neg OR n > 0 THEN CASE WHEN s / nullif(n, 0)::DOUBLE >= 0.9 THEN 'pass' WHEN s / nullif(n, 0)::DOUBLE >= 0.7 THEN 'partial' ELSE 'fail' END END AS groundedness,
  CASE WHEN NOT neg AND o_orderkey % 7 = 0 THEN CASE WHEN {_over("'these results strongly differ'", 'said')} >= 0.25 AND regexp_matches(lower(said), 'conflict|differ') THEN 'pass' WHEN {_over("'these results strongly differ'", 'said')} >= 0.15 THEN 'partial' ELSE 'fail' END END AS disagreement,
  CASE WHEN (o_orderstatus = 'P' OR regexp_matches(lower(said), 'could not find')) = neg THEN 'pass' ELSE 'fail' END AS not_found
FROM (SELECT *, o_orderkey % 3 = 0 AS neg, (o_custkey + {shift}) % 4 AS n, least((o_custkey + {shift}) % 4, o_orderkey % 5) AS s, CASE WHEN (o_custkey + {shift}) % 4 = 0 THEN 'We could not find it' ELSE 'These results differ ' || o_orderpriority END AS said FROM orders)"""


def scores(spark: S, sf: str, shift: int = 0) -> D:
    k, c = F.col("o_orderkey"), F.col("o_custkey") + shift
    said = F.when(c % 4 == 0, "We could not find it").otherwise(F.concat(F.lit("These results differ "), "o_orderpriority"))
    rows = table(spark, sf, "orders").select(
        k.alias("case_id"), (k % 3 == 0).alias("is_negative"), (k % 3 == 0).alias("expected_not_found"), (k % 7 == 0).alias("has_disagreement"), word(WORDS, k).alias("gold_direction"), word(TIERS, k).alias("gold_strength"),
        F.lit("these results strongly differ").alias("disagreement_note"), word(WORDS, c).alias("direction"), word(TIERS, c).alias("strength"), (F.col("o_orderstatus") == "P").alias("stated_not_found"), said.alias("answer_text"), (c % 4).alias("n_claims"), F.least(c % 4, k % 5).alias("n_supported"),
    )
    return answers.score(rows)


@query(_scores(0))
def score_case(spark: S, sf: str) -> D:
    return scores(spark, sf)


_long = lambda t: "(" + " UNION ALL ".join(f"SELECT case_id, '{p}' AS property, {p} AS v FROM {t}" for p in answers.PROPERTIES) + ")"
_lo, _hi = wilson('"pass"', "n")


@query(f"""WITH s AS ({_scores(0)}), t AS (SELECT property, count(*) AS n, sum((v = 'pass')::INTEGER)::BIGINT AS "pass", sum((v = 'partial')::INTEGER)::BIGINT AS partial, sum((v = 'fail')::INTEGER)::BIGINT AS fail FROM {_long("s")} WHERE v IS NOT NULL GROUP BY 1)
SELECT *, round("pass" / n::DOUBLE, 3) AS pass_rate, round({_lo}, 3) AS ci_low, round({_hi}, 3) AS ci_high FROM t""")
def property_summary(spark: S, sf: str) -> D:
    return answers.summary(scores(spark, sf))


@query(f"""WITH a AS ({_scores(0)}), b AS ({_scores(3)}), x AS (SELECT * FROM {_long("a")} WHERE v IS NOT NULL), y AS (SELECT * FROM {_long("b")} WHERE v IS NOT NULL)
SELECT property, count(*) AS n, sum((x.v = 'pass' AND y.v <> 'pass')::INTEGER)::BIGINT AS only_a, sum((y.v = 'pass' AND x.v <> 'pass')::INTEGER)::BIGINT AS only_b FROM x JOIN y USING (case_id, property) GROUP BY 1""")
def paired_compare(spark: S, sf: str) -> D:
    return answers.discordant(scores(spark, sf), scores(spark, sf, 3))


@query("""SELECT c.conv_id AS answer_id, c.turn, coalesce(e.conv_id::VARCHAR, '') AS cited_pmcid, coalesce(e.role, '') AS cited_section, coalesce(e.n, 0)::INTEGER AS cited_char_end FROM conversations c
LEFT JOIN (SELECT conv_id, turn + 1 AS i, role, length(text) AS n FROM conversations) e ON e.conv_id = c.conv_id AND e.i = c.turn * 2 WHERE c.role = 'assistant'""")
def map_claims(spark: S, sf: str) -> D:
    c = table(spark, sf, "conversations")
    said = c.where("role = 'assistant'").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("claim"), (F.col("turn") * 2).alias("excerpt_index"))
    e = c.select(F.col("conv_id").alias("answer_id"), (F.col("turn") + 1).alias("excerpt_index"), F.col("conv_id").alias("pmcid"), F.col("role").alias("section"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"))
    return answers.mapped_claims(said, e).select("answer_id", F.col("claim").alias("turn"), "cited_pmcid", "cited_section", "cited_char_end")


@query("""WITH a AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'up' WHEN event_id % 4 = 0 THEN 'none' ELSE 'mixed' END AS d, CASE WHEN event_id % 4 = 0 THEN 'unstated' ELSE 'high' END AS s, event_id % 4 = 0 AS nf, CASE WHEN event_id % 17 = 0 THEN ' ' ELSE event_type END AS t, CASE WHEN event_id % 4 = 0 AND event_id % 8 > 0 THEN 0 ELSE event_id % 3 END AS k, event_id % 6 AS i FROM events)
SELECT event_id, CASE WHEN d = 'up' THEN 'direction' WHEN trim(t) = '' THEN 'answer_text' WHEN k > 0 AND i < 1 THEN 'claims' WHEN k > 0 AND i > 4 THEN 'unavailable_excerpt' WHEN nf AND k > 0 THEN 'contradiction' WHEN NOT nf AND k = 0 THEN 'no_claims' END AS reason FROM a""")
def validate_answer(spark: S, sf: str) -> D:
    e = F.col("event_id")
    n = F.when((e % 4 == 0) & (e % 8 > 0), F.lit(0)).otherwise((e % 3).cast("int"))
    claim = F.array_repeat(F.struct(F.lit("said").alias("text"), (e % 6).cast("int").alias("excerpt_index")), n)
    answer = {"direction": F.when(e % 13 == 0, "up").when(e % 4 == 0, "none").otherwise("mixed"), "strength": F.when(e % 4 == 0, "unstated").otherwise("high"), "not_found": e % 4 == 0, "answer_text": F.when(e % 17 == 0, " ").otherwise(F.col("event_type")), "claims": claim}
    return table(spark, sf, "events").select("event_id", answers.invalid(answer, F.lit(4)).alias("reason"))


@query("SELECT count(*) AS cases, sum((o_orderkey % 5 = 0)::INTEGER)::BIGINT AS held_out, sum((o_orderstatus = 'O')::INTEGER)::BIGINT AS unreviewed, sum((o_orderstatus = 'P')::INTEGER)::BIGINT AS rejected, sum((o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))::INTEGER)::BIGINT AS missing FROM orders")
def answer_admission(spark: S, sf: str) -> D:
    k = F.col("o_orderkey")
    c = table(spark, sf, "orders").select(k.alias("case_id"), F.when(k % 5 == 0, "held_out").otherwise("dev").alias("split"), F.when(F.col("o_orderstatus") == "P", "rejected").when(F.col("o_orderstatus") == "F", "valid").alias("verdict"))
    return answers.admission(c, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id")))


@query("SELECT count(*) AS cases, count(*) - count(DISTINCT o_custkey) AS duplicate_ids, sum((o_orderstatus = 'P')::INTEGER)::BIGINT AS rejected, sum((o_orderstatus = 'O')::INTEGER)::BIGINT AS unreviewed FROM orders")
def release_gate(spark: S, sf: str) -> D:
    return service.release_counts(table(spark, sf, "orders"), "o_custkey", F.col("o_orderstatus"), "P", "O")


@query("SELECT event_type AS outcome, count(*) AS n, round(avg(value), 6) AS mean_ms, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def outcome_counts(spark: S, sf: str) -> D:
    out = service.outcomes(table(spark, sf, "events"), "event_type", "value", "user_id")
    return out.withColumn("mean_ms", F.round("mean_ms", 6))


_n = "list_sort(list_distinct(regexp_extract_all({x}, '[0-9]+(?:\\.[0-9]+)?')))"


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type AS outcome, count(*) AS n, round(sum(value), 4) AS total_ms FROM events GROUP BY ALL")
def outcome_windows(spark: S, sf: str) -> D:
    w = requests.outcome_windows(table(spark, sf, "events"))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "outcome", "n", F.round("total_ms", 4).alias("total_ms"))
