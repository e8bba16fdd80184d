"""Operators against hand-computed vectors and brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import stats
from palimpsest.functions import text as T
from palimpsest.operators import cases, chunking, index, labels, metrics, spans
from palimpsest.sources import jats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_bm25_equals_brute_force(spark):
    rng = random.Random(0)
    vocabulary = [f"w{i}" for i in range(11)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 25)))) for i in range(40)]
    asks = [(q, " ".join(rng.choice([*vocabulary, "unseen"]) for _ in range(rng.randint(1, 4)))) for q in range(12)]
    chunks, queries = spark.createDataFrame(docs, "chunk_ord long, text string"), spark.createDataFrame(asks, "query_id long, query string")
    tf = {i: Counter(t.split()) for i, t in docs}
    df = Counter(w for c in tf.values() for w in c)
    n, avg = len(docs), sum(sum(c.values()) for c in tf.values()) / len(docs)
    want = {}
    for q, t in asks:
        score = {}
        for w, k in Counter(t.split()).items():
            for i, c in tf.items():
                if c[w]:
                    part = k * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg))
                    score[i] = score.get(i, 0) + part
        for r, (i, s) in enumerate(sorted(((i, round(s, 6)) for i, s in score.items()), key=lambda x: (-x[1], x[0]))[:5], 1):
            want[q, r] = (i, s)
    for got in (index.search(index.build(chunks), queries, 5), index.search_texts(chunks.repartition(3), queries, 5)):
        assert {(r["query_id"], r["rank"]): (r["chunk_ord"], pytest.approx(r["score"], abs=2e-6)) for r in got.collect()} == want
    with pytest.raises(ValueError):
        index.search_texts(chunks, queries, 0)


def test_index_is_stored_once(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "a b"), (1, "b c")], "chunk_ord long, text string")
    index.build(chunks).save(str(tmp_path / "i"))
    again = index.Index.load(spark, str(tmp_path / "i"))
    asks = spark.createDataFrame([(0, "c")], "query_id long, query string")
    assert [r["chunk_ord"] for r in index.search(again, asks, 5).collect()] == [1]
    with pytest.raises(Exception, match="exists"):
        index.build(chunks).save(str(tmp_path / "i"))


def test_ndcg_by_hand(spark):
    run = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "a")], "query_id int, rank int, doc_id string")
    qrels = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (1, "d", 1), (2, "z", 0)], "query_id int, doc_id string, rel int")
    asks = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {r["query_id"]: r for r in metrics.per_query(run, qrels, asks, (1, 3), 3).collect()}
    assert got[1]["ndcg@3"] == pytest.approx((1 / math.log2(3) + 2 / 2) / (2 / 1 + 1 / math.log2(3) + 1 / 2)) and got[1]["recall@3"] == pytest.approx(2 / 3) and got[1]["mrr"] == 0.5
    assert got[2]["ndcg@3"] is None and got[2]["recall@1"] is None and got[2]["mrr"] == got[3]["mrr"] == 0.0


def test_kappa_by_hand(spark):
    levels = ("fail", "partial", "pass")
    for a, b, u, w in (("pass pass fail fail", "pass fail fail fail", 0.5, 0.5), ("pass pass partial fail", "partial pass partial fail", 7 / 11, 5 / 7)):
        df = spark.createDataFrame(list(zip(a.split(), b.split(), strict=True)), "a string, b string")
        r = metrics.kappa(df, "a", "b", levels).first()
        assert (r["unweighted"], r["weighted"]) == (pytest.approx(u), pytest.approx(w))
    same = spark.createDataFrame([("pass", "pass")], "a string, b string")
    assert math.isnan(metrics.kappa(same, "a", "b", levels).first()["unweighted"])


def test_statistics_by_hand(spark):
    for b, c, p in ((0, 0, 1.0), (13, 0, 0.000244140625), (0, 9, 0.00390625), (2, 7, 0.1796875), (5, 5, 1.0)):
        assert one(spark, stats.mcnemar(F.lit(b), F.lit(c))) == pytest.approx(p)
    for s, n, low, high in ((14, 15, 0.7018, 0.9881), (1, 15, 0.0119, 0.2982), (4, 4, 0.5101, 1.0), (0, 4, 0.0, 0.4899), (0, 0, 0.0, 0.0)):
        got = [one(spark, x) for x in stats.wilson(F.lit(s), F.lit(n))]
        assert got == [pytest.approx(low, abs=1e-4), pytest.approx(high, abs=1e-4)]
    df = spark.createDataFrame([("m", 0.0), ("m", 1.0), ("m", None), ("e", None)], "metric string, value double")
    got = {r["metric"]: r for r in stats.bootstrap(df, "metric", "value", 200).collect()}
    assert (got["m"]["value"], got["m"]["n"], got["e"]["n"]) == (0.5, 2, 0) and got["m"]["ci_low"] <= 0.5 <= got["m"]["ci_high"]


def test_text_functions(spark):
    assert one(spark, T.tokens(F.lit("A cancer. c.9275A>G x-y"))) == ["a", "cancer.", "c.9275a", "g", "x-y"]
    assert one(spark, T.numbers_in(F.lit("1,663 of v2.5 and 3.5 x9"))) == ["1663", "3.5"]
    assert one(spark, T.overlap_share(F.lit("1663 amplicons"), F.lit("the amplicons"), 1.0)) == 0.5
    assert one(spark, T.overlap_share(F.lit("?"), F.lit("x"), 1.0)) == 1.0
    assert one(spark, T.classify_section(F.lit("body"), F.lit("Statistical results"))) == "methods"
    assert one(spark, T.classify_section(F.lit("body"), F.lit("Funding"))) is None
    found = one(spark, labels.found(F.lit("He said  “so–so” (twice)."), F.lit('"so-so" (twice)')))
    assert (found["char_start"], found["char_end"]) == (9, 24)
    assert one(spark, labels.direction(F.lit(" No  EFFECT "))) == "none" and one(spark, labels.direction(F.lit("sideways"))) is None
    assert one(spark, labels.grade_strength(F.lit("strong"), F.lit("moderate"))) == "partial"
    assert one(spark, labels.grade_strength(F.lit("none"), F.lit("low"))) == "fail"


def paragraphs(spark, rows):
    df = spark.createDataFrame([(1, "body", i, t, x) for i, (t, x) in enumerate(rows)], "pmcid long, section string, ord int, title string, text string")
    return spans.with_offsets(df)


def test_chunks_are_slices_of_the_section(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["Methods", "Methods", "Results", "Acknowledgements", None]), " ".join(["w"] * rng.choice([0, 0, 3, 120, 200, 390]))) for _ in range(60)]
    p = paragraphs(spark, rows)
    whole = spans.section_text(p).first()["text"]
    want, run, key, size = [], [], None, 0

    def flush():
        nonlocal run, size
        text = "\n".join(rows[i][1] for i in run)
        if len(text.split()) >= 5:
            want.append(text)
        run, size = [], 0

    for i, (title, text) in enumerate(rows):
        n = len(text.split())
        if title == "Acknowledgements":
            flush()
            key = None
            continue
        if run and (title != key or size + n > 350):
            flush()
        run.append(i)
        key, size = title, size + n
    flush()
    got = chunking.structural(p).orderBy("run").collect()
    assert [r["text"] for r in got] == want
    for r in got:
        assert whole[r["source_spans"][0]["char_start"] : r["source_spans"][-1]["char_end"]] == r["text"]


def test_spans_that_touch_do_not_overlap(spark):
    s = "pmcid long, section string, char_start int, char_end int"
    a = spark.createDataFrame([(1, "body", 0, 5), (1, "body", 5, 9)], s)
    b = spark.createDataFrame([(1, "body", 5, 6), (1, "abstract", 0, 9)], s)
    assert [(r[2], r[3]) for r in spans.overlap_join(a, b).select("a.*").collect()] == [(5, 9)]


def test_dereference_errors(spark):
    d = spark.createDataFrame([(1, "body", "abcdef")], "pmcid long, section string, text string")
    s = spark.createDataFrame([(1, "body", 1, 3), (1, "body", 3, 9), (1, "abstract", 0, 1), (2, "body", 0, 1)], "pmcid long, section string, char_start int, char_end int")
    got = sorted((r["pmcid"], r["char_end"], r["error"], r["span_text"]) for r in spans.dereference(s, d, d).collect())
    assert got == [(1, 1, "no_such_section_or_unparseable", None), (1, 3, None, "bc"), (1, 9, "out_of_range", None), (2, 1, "missing_file", None)]


def test_gold_relabelling_closes_ranks(spark):
    hits = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", True), (1, 3, "c", True), (1, 4, "d", False)], "query_id int, rank int, doc_id string, gold boolean")
    assert [(r["rank"], r["doc_id"]) for r in metrics.relabel_gold(hits).orderBy("rank").collect()] == [(1, "a"), (2, "GOLD"), (3, "d")]


def test_articles(spark):
    xml = (
        '<article><front><abstract>bare text</abstract></front><body><p>lead <xref ref-type="bibr">1</xref>, out</p>'
        "<sec><title> A  b </title><p>outer<p>in</p>tail</p><sec><title> </title><p/>"
        '<p>were poor [<xref ref-type="bibr">1</xref>, <xref ref-type="bibr">2</xref>]. BRCA1<sup>mut<xref ref-type="bibr">3</xref></sup> x<sup><xref ref-type="bibr">4</xref>-<xref ref-type="bibr">5</xref></sup>.</p></sec></sec></body></article>'
    )
    df = spark.createDataFrame([(1, xml), (2, "<a>"), (3, None)], "pmcid long, xml string")
    got = [tuple(r) for r in jats.paragraphs(df).orderBy("section", "ord").select("section", "ord", "title", "text", "clean", "char_start", "char_end").collect()]
    assert got[0] == ("abstract", 0, None, "bare text", "bare text", 0, 9)
    assert [g[2] for g in got[1:]] == [None, "A b", "A b", "A b", "A b"]
    assert [g[3] for g in got[1:5]] == ["lead 1, out", "outerintail", "in", ""]
    assert [g[4] for g in got[1:]] == ["lead out", "outerintail", "in", "", "were poor. BRCA1mut x."]
    assert [(g[5], g[6]) for g in got[1:5]] == [(0, 11), (12, 23), (24, 26), (27, 27)]


def test_manifest_merge(spark):
    s = "pmcid long, status string, title string, journal string"
    new, old = spark.createDataFrame([(1, "ok", "", None)], s), spark.createDataFrame([(1, "error", "t", "j"), (2, "ok", "u", "k")], s)
    assert sorted(map(tuple, cases.merged_manifest(new, old).collect())) == [(1, "ok", "t", "j"), (2, "ok", "u", "k")]
