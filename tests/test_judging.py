import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import judging, labels

ROWS = [(1, "carriers had higher risk of disease", "carriers had higher risk"), (2, "carriers had higher risk of disease", "carriers had higher risk"), (3, "nothing shared", "other words"), (4, None, "x"), (5, "{braces} \"quoted\"", None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, claim string, span string").repartition(3)


def test_the_deterministic_judge_equals_the_columns(spark, rows):
    got = {r["id"]: r for r in judging.judged(rows, judging.GROUNDEDNESS, judging.judge("deterministic")).collect()}
    want = {r["id"]: r["s"] for r in rows.select("id", labels.supported(F.col("claim"), F.col("span")).alias("s")).collect()}
    assert len(got) == 5 and {i: r["verdict"] == "true" for i, r in got.items()} == want
    assert all(r["error"] is None and r["tries"] == 1 for r in got.values())


def test_disagreement_verdicts(spark):
    df = spark.createDataFrame([(1, "q", "sources differ about this risk", "sources differ and conflict about this risk"), (2, "q", "sources differ about this risk", "about this"), (3, "q", "sources about risk", None)], "id int, query string, note string, answer string")
    got = {r["id"]: r["verdict"] for r in judging.judged(df, judging.DISAGREEMENT, judging.deterministic).collect()}
    want = {r["id"]: r["v"] for r in df.select("id", labels.disagreement(F.col("note"), F.coalesce("answer", F.lit(""))).alias("v")).collect()}
    assert got == want and set(got.values()) == {"pass", "partial", "fail"}


@pytest.mark.parametrize(
    ("reply", "error"),
    [("no", "not_json"), ("[1]", "not_an_object"), ('{"supported": "true"}', "bad_supported"), ('{"supported": 1}', "bad_supported"), ("{}", "bad_supported"), ('{"supported": true, "rationale": 3}', "rationale_not_text"), (None, "not_json")],
)
def test_replies_are_checked_strictly(reply, error):
    assert judging.checked(judging.GROUNDEDNESS, reply) == (None, None, error)
    assert judging.checked(judging.DISAGREEMENT, '{"verdict": "Pass"}')[2] == "bad_verdict"
    assert judging.checked(judging.GROUNDEDNESS, '{"supported": false}') == ("false", "", None)


def test_busy_scorers_are_asked_again_and_others_are_not():
    slept, calls = [], []

    def flaky(task, fields, prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise judging.Busy(2.5)
        return '{"supported": true}'

    fields = {"claim": "a", "span": "b"}
    assert judging.asked(judging.GROUNDEDNESS, fields, flaky, 6, slept.append) == ("true", "", None, 3) and slept == [2.5, 2.5]
    calls.clear()
    assert judging.asked(judging.GROUNDEDNESS, fields, flaky, 2, slept.append) == (None, None, "busy", 2)

    def broken(task, fields, prompt):
        raise OSError("down")

    assert judging.asked(judging.GROUNDEDNESS, fields, broken, 6, slept.append) == (None, None, "transport:OSError", 1)


def test_failed_rows_stay_and_are_asked_again_on_resumption(spark, rows, tmp_path):
    log = tmp_path / "calls"
    log.write_text("")

    def partly(task, fields, prompt):
        with log.open("a") as f:
            f.write(fields["claim"] + "\n")
        if "nothing" in fields["claim"]:
            raise TimeoutError
        return json.dumps({"supported": True})

    first = judging.judged(rows, judging.GROUNDEDNESS, partly, parallel=2)
    assert first.count() == 5 and log.read_text().count("carriers") == 1  # alike requests are sent once
    assert {r["error"]: r["n"] for r in judging.failures(first).collect()} == {"transport:TimeoutError": 1}
    with pytest.raises(RuntimeError, match="TimeoutError"):
        judging.required(first)
    log.write_text("")
    again = judging.judged(rows, judging.GROUNDEDNESS, judging.deterministic, replies=first)
    assert log.read_text() == "" and judging.required(again).count() == 5
    assert {r["id"]: r["verdict"] for r in again.collect()} == {1: "true", 2: "true", 3: "false", 4: "true", 5: "true"}


def test_judges_by_name():
    assert judging.judge("deterministic") is judging.deterministic
    with pytest.raises(RuntimeError):
        judging.judge("remote", lambda prompt, key: "", None)
    with pytest.raises(ValueError):
        judging.judge("no such judge")
    assert judging.judge("remote", lambda prompt, key: key + prompt, "k")(judging.GROUNDEDNESS, {}, "p") == "kp"


def test_empty_table(spark, rows):
    assert judging.judged(rows.limit(0), judging.GROUNDEDNESS, judging.deterministic).collect() == []
