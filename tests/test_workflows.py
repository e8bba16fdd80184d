"""Verification, mining and review operators on small tables worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import stats
from palimpsest.functions import text as T
from palimpsest.operators import index, mining, service, spans, verification
from palimpsest.sources import files


def test_exact_p_of_large_counts(spark):
    p = lambda b, c: spark.range(1).select(stats.mcnemar(F.lit(b), F.lit(c)).alias("p")).first()["p"]
    assert p(540, 540) == 1.0 and p(1000, 1001) == 1.0 and p(5000, 5000) == 1.0
    for b, c in ((500, 560), (1100, 1000), (2000, 1900)):
        n, k = b + c, min(b, c)
        want = min(1, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + n * math.log(0.5)) for i in range(k + 1)))
        assert p(b, c) == pytest.approx(want, rel=1e-6)
    assert 0 <= p(3000, 0) < 1e-300 or p(3000, 0) == 0


def test_quotes_and_their_sentences(spark):
    note = "it says 'First sentence here. Second one; and a third part' and 'short' and 'another long block'"
    got = spark.range(1).select(T.quote_candidates(F.lit(note)).alias("q")).first()["q"]
    assert got == ["First sentence here. Second one; and a third part", "First sentence here.", "and a third part", "another long block"]


def test_verbatim_places(spark):
    texts = [(1, "s", "xx red fox runs xx"), (2, "s", "the red fox runs, red fox runs"), (3, "s", "a red cat runs"), (4, "s", "prefoxes"), (5, "s", None)]
    items = [(1, "red fox runs"), (2, "fox"), (3, "nowhere to be seen"), (4, "e red fo"), (5, "")]
    got = spans.verbatim(spark.createDataFrame(items, "item_id int, item string"), spark.createDataFrame(texts, "pmcid int, section string, text string")).collect()
    assert sorted((r["item_id"], r["pmcid"], r["char_start"], r["char_end"]) for r in got) == [(1, 1, 3, 15), (1, 2, 4, 16), (2, 1, 7, 10), (2, 2, 8, 11), (2, 4, 3, 6), (4, 2, 2, 10)]


def test_span_statuses(spark):
    sections = [(1, "abstract", "alpha beta gamma delta"), (1, "body", "one line\nthe gene and a quoted passage here\nlast"), (2, "body", "nothing of note")]
    quote = "note 'a quoted passage here'"
    rows = [
        ("ok", 1, "body", 9, 43, quote, "c.gene", "the"), ("moved", 1, "abstract", 0, 5, quote, "c.zzz", "the"), ("refused", 1, "body", 0, 3, quote, "c.zzz", "qqq"),
        ("none", 1, "body", 0, 8, "no quotes", "c.line", "the"), ("beyond", 1, "body", 0, 99, "", "c.line", "the"), ("section", 2, "abstract", 0, 3, quote, None, "the"), ("file", 9, "body", 0, 3, quote, None, "the"),
    ]
    s = spark.createDataFrame(sections, "pmcid int, section string, text string")
    c = spark.createDataFrame(rows, "span_id string, pmcid int, section string, char_start int, char_end int, note string, variant string, gene string")
    d = spark.createDataFrame([(1,), (2,)], "pmcid int")
    got = {r["span_id"]: r for r in verification.span_statuses(c, s, d).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"ok": "OK", "moved": "FIXED", "refused": "REFUSED_FIX", "none": "NO_QUOTE_TO_VERIFY", "beyond": "NO_QUOTE_TO_VERIFY", "section": "NO_SUCH_SECTION", "file": "MISSING_FILE"}
    assert (got["moved"]["new_section"], got["moved"]["new_start"], got["moved"]["new_end"]) == ("body", 9, 43)
    assert (got["refused"]["new_start"], got["refused"]["new_end"], got["refused"]["subject"]) == (0, 3, "absent")
    assert got["none"]["in_range"] and not got["beyond"]["in_range"] and got["none"]["subject"] == "ok" and got["moved"]["subject"] == "gene_only"
    assert {r["status"] for r in verification.span_statuses(c, s, d, fix=False).where("span_id = 'refused'").collect()} == {"FIXED"}


def test_number_drift(spark):
    span = lambda e: [(1, "body", 0, e)]
    rows = [("ok", False, "it was 12 of 40", span(20)), ("missing", False, "7, 1234 and 55", span(20)), ("none", False, "no number", span(20)), ("empty", False, "5", []), ("negative", True, "5", span(20)), ("error", False, "5", span(999))]
    c = spark.createDataFrame(rows, "case_id string, is_negative boolean, claim string, gold_spans array<struct<pmcid:int,section:string,char_start:int,char_end:int>>")
    s = spark.createDataFrame([(1, "body", "12 patients among 40 seen")], "pmcid int, section string, text string")
    got = {r["case_id"]: (r["status"], r["missing"]) for r in verification.number_drift(c, s, s.select("pmcid")).collect()}
    assert got == {"ok": ("ok", []), "missing": ("missing_numbers", ["1234", "55", "7"]), "none": ("no_numeric_claim", []), "empty": ("no_spans", []), "negative": ("no_spans", []), "error": ("span_error", [])}


def test_hold_out_is_idempotent(spark):
    docs = spark.createDataFrame([(i,) for i in range(5)], "pmcid int")
    registry = spark.createDataFrame([("p1", 0)], "pair_id string, pmcid int")
    asks = spark.createDataFrame([("p1", 0), ("p2", 0), ("p2", 1), ("p3", 1), ("p3", 77), ("p3", 2), ("p3", 2)], "pair_id string, pmcid int")
    got = verification.hold_out(registry, asks, docs)
    assert sorted(tuple(r) for r in got.collect()) == [("p1", 0, "skipped"), ("p2", 0, "refused"), ("p2", 1, "held_out"), ("p3", 1, "refused"), ("p3", 2, "held_out"), ("p3", 77, "missing")]
    now = registry.unionByName(got.where("outcome = 'held_out'").select("pair_id", "pmcid"))
    assert verification.hold_out(now, asks, docs).where("outcome = 'held_out'").count() == 0
    assert sorted(r["pmcid"] for r in verification.restored(now, F.lit("p3")).collect()) == [0, 1]


def test_negatives(spark):
    cases = [("clean", "absent words here", [9], "hold_out"), ("found", "Some TEXT stands", [9], "hold_out"), ("listed", "absent words here", [8], "hold_out"), ("searched", "absent words here", [], "search")]
    c = spark.createDataFrame(cases, "case_id string, literal string, held_out_pmcids array<int>, construction string")
    d = spark.createDataFrame([(1, "and some text stands here"), (8, "x")], "pmcid int, text string")
    got = {r["case_id"]: (r["n_articles"], r["unregistered"], r["present"], r["ok"]) for r in verification.negatives(c, d, spark.createDataFrame([(9,)], "pmcid int")).collect()}
    assert got == {"clean": (0, 0, 0, True), "found": (1, 0, 0, False), "listed": (0, 1, 1, False), "searched": (0, 0, 0, False)}


def test_rare_variants(spark):
    rows = [(1, "body", 0, "TP53 and BRCA1 c.12A>G, c.4_6del in Breast Cancer"), (1, "body", 1, "c.12A>G again in breast cancer"), (2, "body", 0, "c.9dup in ovarian cancer"), (3, "body", 0, "BRCA2 c.9dup without a condition"), (3, "body", 1, "c.4_6del, prostate cancer")]
    p = spark.createDataFrame(rows, "pmcid int, section string, ord int, text string")
    got = [tuple(r) for r in mining.rare_variants(p).collect()]
    assert got == [("c.12A>G", "BRCA1", 1, "breast cancer", 1, 1), ("c.9dup", "UNKNOWN", -1, "ovarian cancer", 1, 2)]
    assert {r["variant"]: r["df"] for r in mining.rare_variants(p, 2).collect()} == {"c.12A>G": 1, "c.9dup": 1, "c.4_6del": 2}


def test_words_nearest_before(spark):
    """One pattern finds what a search name by name finds, and texts are read once for places and frequencies."""
    import random
    import re

    r, names = random.Random(5), ["BRCA1", "ATM", "TP53", "BRCA", "ATM"]
    texts = ["".join(r.choice(["BRCA1", "ATM", "TP53", "BRCA", "x", " ", " ", "-", "\n", "_", "."]) for _ in range(r.randint(0, 40))) for _ in range(300)]
    rows = [(t, r.randint(0, len(t))) for t in texts]

    def nearest(t, at):
        w = t[max(at - 60, 0) : at]
        ends = [(len(w) - m.end(), i, n) for i, n in enumerate(names) for m in re.finditer(rf"\b{n}\b", w, re.ASCII)]
        return (min(ends)[2], min(ends)[0]) if ends else (None, -1)

    got = mining.nearest_before(spark.createDataFrame(rows, "text string, at int"), "text", "at", names).collect()
    assert [(x["name"], x["distance"]) for x in got] == [nearest(*x) for x in rows] and len({x["name"] for x in got}) == 5
    # names that may lie in each other are still sought one by one
    odd = mining.nearest_before(spark.createDataFrame([("a b c", 5)], "text string, at int"), "text", "at", ["a b", "a b c", "c"]).first()
    assert (odd["name"], odd["distance"]) == ("a b c", 0)
    p = spark.createDataFrame([(1, "body", 0, "TP53 c.12A>G in breast cancer")], "pmcid int, section string, ord int, text string")
    out = mining.rare_variants(p)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 4
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        assert "ReusedExchange" in mining.rare_variants(p)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_dataset_needs_three_files(spark, tmp_path):
    for name, line in (("corpus.jsonl", '{"id": "d", "title": "T", "text": "x"}'), ("queries.jsonl", '{"id": "q", "text": "x"}')):
        (tmp_path / name).write_text(line + "\n\n")
    with pytest.raises(FileNotFoundError, match="qrels.txt"):
        files.dataset(spark, str(tmp_path))
    (tmp_path / "qrels.txt").write_text("q 0 d 1\nq 0 e 0\n")
    s = files.dataset(spark, str(tmp_path))
    assert [tuple(r) for r in s.texts().collect()] == [("d", "T x")] and [r["doc_id"] for r in s.relevant().collect()] == ["d"]
    (tmp_path / "corpus.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        files.beir(spark, str(tmp_path / "corpus.jsonl"), files.BEIR_CORPUS).collect()


def test_review(spark):
    hits = spark.createDataFrame([(1, True, True), (1, False, False), (2, False, True), (3, True, True)], "query_id int, gold boolean, answers boolean")
    r = service.hole_rate(hits, F.col("answers")).first()
    assert (r["n"], r["holes"]) == (3, 1) and r["ci_low"] < 1 / 3 < r["ci_high"]
    lines = spark.createDataFrame([(1, 1, "## a", None), (1, 2, None, "wrong"), (1, 3, None, "valid"), (1, 4, "## b", None), (1, 5, None, ""), (1, 6, "## c", None)], "sheet int, line_no int, head string, said string")
    v = service.worksheet_verdicts(lines, F.col("head"), F.col("said"))
    assert sorted((x["case_id"], x["verdict"]) for x in v.collect()) == [("## a", "valid"), ("## b", "")]
    r = service.worksheet_error_rate(v).first()
    assert (r["cases"], r["valid"], r["wrong"], r["unfilled"], r["wrong_rate"]) == (2, 1, 0, 1, 0.0)


def test_chunks_without_tokens_are_counted(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "a b"), (1, "--"), (2, None)], "chunk_ord long, text string")
    index.build(chunks).save(str(tmp_path / "i"))
    i = index.Index.load(spark, str(tmp_path / "i"))
    assert i.corpus.first() == (3, 2 / 3) and sorted(tuple(r) for r in i.lengths.collect()) == [(0, 2), (1, 0), (2, 0)]


def test_package_is_sent_to_other_machines(spark, monkeypatch):
    """Where the driver stands says nothing of executors elsewhere; a local session needs nothing sent."""
    from palimpsest import session

    sent = []
    monkeypatch.setattr(session, "_shipped", set())
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: sent.append(path))
    monkeypatch.chdir(session.ROOT)
    session.ship(spark)
    assert not sent
    monkeypatch.setattr(session, "local", lambda s: False)
    session.ship(spark)
    session.ship(spark)
    assert len(sent) == 1


def test_entry_hides_no_other_import_error(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    class Absent:
        def __init__(self, name):
            self.name = name

        def find_spec(self, name, path=None, target=None):
            if name == self.name:
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name, fails in (("palimpsest.llm", False), ("ahocorasick", True)):
        held = {k: m for k, m in sys.modules.items() if k.startswith("palimpsest.llm") or k == "ahocorasick"}
        for k in held:
            monkeypatch.delitem(sys.modules, k)
        finder = Absent(name)
        monkeypatch.setattr(sys, "meta_path", [finder, *sys.meta_path])
        if fails and not any(k.startswith("palimpsest.llm") for k in held):
            continue  # the llm folder isn't there
        if fails:
            with pytest.raises(ModuleNotFoundError, match=name):
                importlib.reload(__spark_entry__)
        else:
            importlib.reload(__spark_entry__)
            assert "bm25_topk" in __spark_entry__.queries() and "op1_compact_windows" not in __spark_entry__.queries()
        monkeypatch.setattr(sys, "meta_path", [f for f in sys.meta_path if f is not finder])
        sys.modules.update(held)
    importlib.reload(__spark_entry__)
