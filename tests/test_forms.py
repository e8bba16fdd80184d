import random
import re
from itertools import pairwise

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.operators import forms


def brute(text, terms, edges, ignore_case):
    """What one alternation a group finds."""
    out = []
    for g in {g for g, _ in terms}:
        mine = sorted({t.strip() for x, t in terms if x == g and t and t.strip()}, key=lambda t: (-len(t), t))
        body = "|".join(map(re.escape, mine))
        pattern = {"word": rf"\b(?:{body})\b", "alnum": rf"(?<![A-Za-z0-9])(?:{body})(?![A-Za-z0-9])", "any": body}[edges]
        out += [(g, m.group(0), m.start(), m.end()) for m in re.finditer(pattern, text or "", re.IGNORECASE if ignore_case else 0)] if mine else []
    return sorted(out)


PARTS = ["c.68A>G", "c.68", "A", ">", "G", "185delAG", "del", "rs123", "breast cancer", "cancer", "breast", " ", ",", "(", ")", "_", "é", "-", "7", "BRCA1", "brca1"]
TERMS = [("x", "c.68A>G"), ("x", "c.68"), ("x", "185delAG"), ("y", "breast cancer"), ("y", "cancer"), ("y", "breast"), ("x", "(rs123)"), ("z", "BRCA1"), ("y", "BRCA1"), ("z", ">")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), st.sampled_from(forms.EDGES), st.booleans())
def test_matcher_equals_the_alternation(text, edges, ignore_case):
    found = forms.Matcher(TERMS, edges, ignore_case).leftmost(text)
    assert sorted((g, text[a:b], a, b) for a, b, g in found) == brute(text, TERMS, edges, ignore_case)


def test_case_is_ignored_in_place():
    text = "İstanbul BRCA1 İ brca1"
    assert [(a, b) for a, b, _ in forms.Matcher([("g", "Brca1")]).leftmost(text)] == [(9, 14), (17, 22)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    return [(i, "".join(r.choices(PARTS, k=30))) for i in range(120)] + [(500, None), (501, ""), (502, "cancer " * 20_000)]


@pytest.mark.parametrize("most_bytes", [forms.MOST_BYTES, 1])
def test_one_automaton_and_many_agree(spark, texts, most_bytes):
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    terms = spark.createDataFrame([*TERMS, ("x", None), (None, "G"), ("x", " "), ("y", " cancer ")], "terms string, term string")
    got = sorted(tuple(r) for r in forms.occurrences(df, ["id"], terms, most_bytes=most_bytes).collect())
    assert got == sorted((i, *m) for i, t in texts for m in brute(t, TERMS, "word", True))


def test_ten_thousand_terms_and_none(spark):
    df = spark.createDataFrame([(i, f"before c.{i}A>G, after c.{i}A>GT") for i in range(300)], "id long, text string")
    terms = spark.range(10_000).selectExpr("'g' as terms", "concat('c.', id, 'A>G') as term")
    found = forms.occurrences(df, ["id"], terms, edges="alnum", ignore_case=False)
    assert found.count() == 300 and found.where("start <> 7").count() == 0
    assert forms.occurrences(df, ["id"], terms.limit(0)).collect() == []
    plan = found._jdf.queryExecution().toString()
    assert len(plan) < 5_000  # the terms aren't in the plan


def test_matches_of_a_group_do_not_overlap(spark, texts):
    df = spark.createDataFrame(texts[:60], "id long, text string")
    rows = sorted((r["id"], r["terms"], r["start"], r["stop"]) for r in forms.occurrences(df, ["id"], spark.createDataFrame(TERMS, "terms string, term string")).collect())
    assert all(a[:2] != b[:2] or a[3] <= b[2] for a, b in pairwise(rows))


def test_candidates_by_real_names(spark):
    from palimpsest.operators import mining

    filler = "and then many more words follow so that the paragraph is long enough to be a candidate of this search for names in full"
    rows = [("A1", "s", 0, f"We saw c.68A>G here {filler}"), ("A2", "s", 0, f"We saw (185delAG) here {filler}"), ("A3", "s", 0, f"c.68A>G or 185delAG {filler}"), ("A4", "s", 0, f"c.68A>Gx or C.68a>g {filler}"), ("A5", "s", 0, "c.68A>G short")]
    p = spark.createDataFrame(rows, "pmcid string, section string, ord int, text string")
    pairs = spark.createDataFrame([("k", "c.68A>G", "185delAG", 12), ("common", "185delAG", "c.68A>G", 13)], "pair_id string, form_a string, form_b string, n_articles int")
    got = [tuple(r) for r in mining.one_form_only(p, pairs).collect()]
    assert got == [("k", "185delAG", "c.68A>G", "A2", "s", 0, 1), ("k", "c.68A>G", "185delAG", "A1", "s", 0, 1)] or got == [("k", "c.68A>G", "185delAG", "A1", "s", 0, 1), ("k", "185delAG", "c.68A>G", "A2", "s", 0, 1)]
    assert mining.one_form_only(p, pairs.limit(0)).collect() == []


def test_coverage_takes_terms_in_any_case_and_sets_without_subject(spark):
    from palimpsest.operators import mining

    rows = [("A1", "s", 0, "BRCA1 in Breast  Cancer"), ("A1", "s", 1, "brca1 and breast cancer, cancer"), ("A2", "s", 0, "BRCA1X breast cancers"), ("A3", "s", 0, "Brca1"), ("A3", "s", 1, "CANCER")]
    p = spark.createDataFrame(rows, "pmcid string, section string, ord int, text string")
    got = mining.coverage(p, [("one", ["BRCA1", " "], ["breast cancer", "cancer"]), ("none", [], ["cancer"])]).orderBy("pmcid").collect()
    assert [(r["pmcid"], r["strength"], r["n_same_paragraph_hits"], r["subject_terms"], r["condition_terms"], r["ord"]) for r in got] == [
        ("A1", "same_paragraph", 2, "BRCA1;brca1", "Cancer;breast cancer;cancer", 0),
        ("A3", "doc_level_only", 0, "Brca1", "CANCER", 0),
    ]
