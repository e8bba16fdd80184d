import random

import pytest

from palimpsest.operators import spans

SPAN = "id int, pmcid int, section string, char_start int, char_end int"


@pytest.mark.parametrize("width", [1, 7, 64, 2048])
def test_overlap_join_equals_brute_force(spark, width):
    r = random.Random(width)
    make = lambda n: [(i, r.choice([1, 2, None]), r.choice(["en", "de", None]), s := r.randint(0, 300), s + r.choice([0, 1, 5, 40, 250])) for i in range(n)]
    x, y = make(120), make(150)
    want = sorted((a[0], b[0]) for a in x for b in y if None not in a[1:3] and a[1:3] == b[1:3] and a[3] < b[4] and b[3] < a[4])
    got = spans.overlap_join(spark.createDataFrame(x, SPAN), spark.createDataFrame(y, SPAN), width)
    assert got.columns == SPAN.replace(" int", "").replace(" string", "").split(", ") * 2
    assert sorted(map(tuple, got.select("a.id", "b.id").collect())) == want and want


def test_one_long_section(spark):
    paragraphs = spark.range(100_000).selectExpr("cast(id as int) as id", "1 as pmcid", "'en' as section", "cast(id * 101 as int) as char_start", "cast(id * 101 + 100 as int) as char_end")
    items = spark.range(2_000).selectExpr("cast(id as int) as id", "1 as pmcid", "'en' as section", "cast(id * 5003 as int) as char_start", "cast(id * 5003 + 150 as int) as char_end")
    got = spans.overlap_join(items, paragraphs)
    want = sum(1 for i in range(2000) for k in range(max(0, i * 5003 // 101 - 1), i * 5003 // 101 + 4) if k < 100_000 and i * 5003 < k * 101 + 100 and k * 101 < i * 5003 + 150)
    assert got.count() == want
    spread = got.groupBy("a.id").count().agg({"count": "max"}).first()[0]
    assert spread <= 3


def test_verbatim_in_null_sections_and_short_items(spark):
    texts = [(1, None, "here the quick brown fox runs"), (2, "en", "the quick brown fox"), (3, None, "a b. fox"), (4, "en", None), (5, "de", "xfoxy")]
    items = [(1, "quick brown fox"), (2, "fox"), (3, "b."), (4, ""), (5, " fox"), (6, None), (7, "the quick brown")]
    got = spans.verbatim(spark.createDataFrame(items, "item_id int, item string"), spark.createDataFrame(texts, "pmcid int, section string, text string"))
    want = sorted(((i, p, s or "", t.index(x), t.index(x) + len(x)) for i, x in items for p, s, t in texts if x and t and x in t), key=repr)
    assert sorted(((r[0], r[1], r[2] or "", r[3], r[4]) for r in got.collect()), key=repr) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_text_never_travels_with_its_spans(spark):
    """Spans of one article are dealt once, before its text is beside them; what is wrong with each is told."""
    section = "x" * 10 + "é" * 10
    texts = spark.createDataFrame([(1, "body", section), (1, None, "null section"), (2, "body", "no article"), (4, "body", None)], "pmcid int, section string, text string")
    known = spark.createDataFrame([(1,), (3,), (4,), (1,)], "pmcid int")
    rows = [
        (1, 1, "body", 8, 12), (2, 1, "body", 0, 20), (3, 1, "body", 0, 21), (4, 1, "body", 5, 5), (5, 1, "body", -1, 5), (6, 1, None, 0, 4), (7, 1, "abstract", 0, 4),
        (8, 2, "body", 0, 2), (9, 3, "body", 0, 2), (10, None, "body", 0, 2), (11, 4, "body", 0, 2), (12, None, None, 0, 2),
    ]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = spans.dereference(spark.createDataFrame(rows, SPAN), texts, known)
        got = {r["id"]: (r["error"], r["span_text"]) for r in out.collect()}
        join = out._jdf.queryExecution().optimizedPlan().children().apply(0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    none, absent, beyond = ("no_such_section_or_unparseable", None), ("missing_file", None), ("out_of_range", None)
    assert got == {1: (None, "xxéé"), 2: (None, section), 3: beyond, 4: beyond, 5: beyond, 6: none, 7: none, 8: absent, 9: none, 10: absent, 11: none, 12: absent}
    assert join.nodeName() == "Join" and "_text" not in join.left().output().toString()  # the last join is that with the texts


def test_faults_of_one_pass(spark):
    """Anchors, digests and shares are told of paragraphs with both styles; repeated sections and null values count."""
    from palimpsest.functions import text as T
    from palimpsest.operators import cases

    texts = spark.createDataFrame([(1, "body", "alpha beta gamma delta")], "pmcid int, section string, text string")
    sha1 = texts.select(T.digest(texts.text)).first()[0]
    row = lambda p, s, q, pmcid=1, end=22, sha=sha1, share=1.0, anchors=(): (f"{p}#{s}", p, s, q, pmcid, "body", 0, end, sha, share, list(anchors))
    rows = [
        row("good", "lexical", "alpha"), row("good", "paraphrased", "beta x", share=0.5), row("one", "lexical", "alpha one", sha="?"),
        row("bad", "lexical", "Gamma", sha=None, anchors=["ALPHA", "zzz", None, "y"]), row("bad", "paraphrased", "gamma", share=0.25),
        row("far", "lexical", "far", end=23, share=0.0), row("far", "paraphrased", "far far", pmcid=9),
    ]
    rows = spark.createDataFrame(rows, "query_id string, paragraph_id string, style string, query string, pmcid int, section string, char_start int, char_end int, gold_text_sha1 string, lexical_overlap double, anchors array<string>")
    got = sorted(map(tuple, cases.violations(rows, texts, texts, spark.createDataFrame([(9,)], "pmcid int")).collect()))
    assert got == sorted([("styles", "one", "lexical"), ("digest", "bad", sha1), ("anchor", "bad", "zzz"), ("anchor", "bad", "y"), ("overlap", "bad#paraphrased", "1.0000"), ("span", "far", "out_of_range"), ("duplicate_text", "gamma", "2"), ("held_out", "9", ""), ("concentration", "1", "4")])


def test_lines_have_the_offsets_of_paragraphs(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["en", None]), "\n".join("é" * r.randint(0, 5) for _ in range(r.choice([1, 2, 40, 300])))) for i in range(20)] + [(90, "en", ""), (91, "en", "\n\n"), (92, "en", None)]
    sections = spark.createDataFrame(rows, "pmcid int, section string, text string")
    want = spans.with_offsets(sections.selectExpr("pmcid", "section", r"posexplode(split(text, '\n')) as (ord, text)"))
    got = spans.lines(sections)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
