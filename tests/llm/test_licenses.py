import re

import duckdb

from palimpsest.llm import licenses, queries
from tests.conftest import SF


def brute(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    cut = lambda s: [w for w in re.split(licenses.SEPARATOR, s) if w]
    w = cut(low)
    at, base, labels, score = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += found
        base |= {label} if found else set()
    for line in low.split("\n"):
        for name, t in licenses.TEMPLATES.items():
            t = set(t.split())
            n = len(t & set(cut(line)))
            if n >= licenses.THRESHOLD * len(t) - 1e-9:
                labels.add(name)
                score = max(score, n / len(t))
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score)


ROWS = [
    (1, None, 0.0),
    (2, "", 0.0),
    (3, " ..\n", 0.0),
    (4, "Released under the MIT License.", 0.0),
    (4, "Released under the MIT License.", 0.0),
    (5, "a CC BY cc by CC-BY x\nccby\nGNU General  Public\tLicense, gnu general public license", 0.0),
    (6, "x é mit licenseé mit license" + " word" * 30_000 + " apache license", 0.0),
    (7, licenses.TEMPLATES["mit-grant"].upper() + "\n" + " ".join(licenses.TEMPLATES["bsd-grant"].split()[:15]), 0.0),
    (8, "under license the released", 0.0),
    (None, "mit license", 0.0),
]


def test_equals_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, score double")
    got = sorted((str(r[0]), *r[1:]) for r in licenses.scan(df).collect())
    assert got == sorted((str(i), *brute(t)) for i, t, _ in ROWS)
    assert licenses.scan(df.limit(0)).collect() == []


def test_query_equals_sql(spark):
    got = sorted(map(tuple, queries.op7_license_set_join(spark, SF).collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert got == sorted(c.execute(licenses.oracle()).fetchall())
    assert any(r[3] is not None for r in got)


def test_no_python_in_the_plan(spark):
    plan = queries.op7_license_set_join(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
