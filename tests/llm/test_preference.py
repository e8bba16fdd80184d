import re

import duckdb

from palimpsest.llm import preference as p
from palimpsest.llm import queries
from tests.conftest import SF


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def show(turns):
        out, marks = "", []
        for role, text in turns:
            out += f"<|im_start|>{role}\n"
            start = len(out)
            out += text.replace("<|im_", "<| im_") + "<|im_end|>"
            if role == "assistant":
                marks.append(f"{start}:{len(out)}")
            out += "\n"
        return out, ",".join(marks)

    (prompt, _), (a, am), (b, bm) = show(chosen[:n]), show(chosen[n:]), show(rejected[n:])
    return n, prompt, a, b, am, bm


def test_prefix_and_masks(spark):
    u, a, s = "user", "assistant", "system"
    cases = [
        ([(s, "be"), (u, "hi"), (a, "yes")], [(s, "be"), (u, "hi"), (a, "no"), (u, "?"), (a, "é𝒳<|im_end|>")]),
        ([(u, "x")], [(u, "x")]),
        ([], [(a, "only")]),
        ([(u, "x"), (a, "y")], [(a, "x"), (a, "y")]),
        ([(u, "w" * 50_000), (a, "")], [(u, "w" * 50_000)]),
        ([(u, "x"), (a, "y"), (u, "z")], [(u, "x"), (a, "y")]),
    ]
    rows = [(i, *c, "extra") for i, c in enumerate(cases)]
    t = "array<struct<role string, text string>>"
    df = spark.createDataFrame(rows, f"conv_id long, chosen {t}, rejected {t}, n string")
    got = {r[0]: tuple(r)[1:] for r in p.formatted(df).collect()}
    assert got == {i: brute(*c) for i, c in enumerate(cases)}
    assert p.formatted(df.limit(0)).collect() == []


def test_odd_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, None, None), (2, 0, "user", "q"), (3, 0, "assistant", "r"), (3, 0, "assistant", "r"), (None, 0, "user", "z")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    got = {r[0]: tuple(r)[1:] for r in p.formatted(p.contrasted(p.dialogues(df))).collect()}
    one = [("user", ""), ("user", "a"), ("assistant", "b")]
    assert got == {1: brute(one, [*one[:2], ("assistant", "")]), 2: brute([("user", "q")], [("user", "q")]), 3: brute([("assistant", "r")] * 2, [("assistant", "r")] * 2)}


def test_query_equals_sql_without_python(spark):
    df = queries.op5_preference_chat(spark, SF)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    assert sorted(map(tuple, df.collect())) == sorted(c.execute(p.oracle()).fetchall())
