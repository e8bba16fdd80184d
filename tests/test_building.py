import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import building

STRATA = ("abstract", "methods", "results")


def generate(row):
    if row["id"] % 11 == 0:
        raise TimeoutError
    if row["id"] % 13 == 0:
        return ["not an object"]
    return {"query": f"what is {row['id']}?", "answer": None if row["id"] % 3 == 0 else "this"}


def attempt(rows):
    made = building.attempting(generate, ["id"], "query string, answer string")(rows)
    return made.withColumn("reason", F.coalesce("failed", F.when(F.col("answer").isNull(), "declined: nothing to ask")))


@pytest.fixture(scope="module")
def candidates(spark):
    r = random.Random(2)
    rows = [(i, f"A{r.randrange(150)}", r.choice(STRATA)) for i in range(600)] + [(1000 + i, f"R{i}", "rare") for i in range(4)]
    return spark.createDataFrame(rows, "id long, pmcid string, stratum string").repartition(5)


def make(spark, folder, quota=12):
    return building.Build(spark, str(folder), quota, "id", "stratum", "pmcid")


def rows(df):
    return sorted(tuple(r) for r in df.select("id", "stratum", "place", "query", "answer").collect())


@pytest.fixture(scope="module")
def whole(spark, candidates, tmp_path_factory):
    return make(spark, tmp_path_factory.mktemp("whole")).run(candidates, attempt)


def test_quotas_reasons_and_one_a_stratum_and_article(spark, candidates, whole):
    got = whole.accepted().collect()
    assert {s: sum(r["stratum"] == s for r in got) for s in STRATA} == dict.fromkeys(STRATA, 12)
    assert len({(r["pmcid"], r["stratum"]) for r in got}) == len(got)
    assert all(r["id"] % 11 and r["id"] % 13 and r["id"] % 3 for r in got)
    reasons = {r["reason"]: r["n"] for r in whole.reasons().collect()}
    assert set(reasons) >= {"declined", "call_failed"}
    s = {r["stratum"]: r for r in whole.summary().collect()}
    assert s["rare"]["tried"] == 4 and s["rare"]["short"] == 12 - s["rare"]["accepted"] and s["results"]["short"] == 0
    # in the order of the pool, the first that count
    drawn = building.pool(candidates, "id", "stratum", "pmcid", 36).collect()
    for name in STRATA:
        mine = sorted((r["place"], r["id"]) for r in drawn if r["stratum"] == name and r["id"] % 11 and r["id"] % 13 and r["id"] % 3)
        assert sorted((r["place"], r["id"]) for r in got if r["stratum"] == name) == mine[:12]


def test_stops_when_the_quotas_are_met(spark, candidates, tmp_path):
    b = make(spark, tmp_path, 3).run(candidates.where("stratum <> 'rare'"), attempt)
    assert b.spark.read.parquet(f"{tmp_path}/drawn").count() == 27
    assert b.accepted().count() == 9 and b.accepted().count() + b.rejected().count() < 27


@pytest.mark.parametrize("dies_at", [1, 2])
def test_killed_and_resumed_gives_the_same_rows(spark, candidates, whole, tmp_path, dies_at):
    calls = []

    def dying(frame):
        calls.append(1)
        if len(calls) == dies_at + 1:
            raise MemoryError("killed")
        return attempt(frame)

    b = make(spark, tmp_path)
    with pytest.raises(Exception, match="killed"):
        b.run(candidates, dying)
    part = b.accepted().count()
    again = make(spark, tmp_path).run(candidates, attempt)
    assert part < again.accepted().count() and rows(again.accepted()) == rows(whole.accepted())
    assert rows(again.rejected()) == rows(whole.rejected())
    assert rows(make(spark, tmp_path).run(candidates, attempt).accepted()) == rows(whole.accepted())  # a further run adds nothing


def test_a_batch_killed_between_its_writes_replaces_itself(spark, candidates, whole, tmp_path):
    b = make(spark, tmp_path)
    kept = b._batch

    def halfway(attempt_, full):
        inner = kept(attempt_, full)

        def run(frame, number):
            inner(frame, number)
            if number == 1:
                raise OSError("killed after its rows were written")

        return run

    b._batch = halfway
    with pytest.raises(Exception, match="killed"):
        b.run(candidates, attempt)
    assert rows(make(spark, tmp_path).run(candidates, attempt).accepted()) == rows(whole.accepted())


def test_no_candidates(spark, candidates, tmp_path):
    b = make(spark, tmp_path).run(candidates.limit(0), attempt)
    assert b.counts() == {} and b.summary().collect() == []
