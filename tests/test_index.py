import random

import pytest

from palimpsest import plans
from palimpsest.operators import index
from tests.conftest import SF


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [(i * 3, " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(60)], k=r.randint(0, 40)))) for i in range(400)] + [(5000, None), (5001, "w0 w1"), (5002, "w0 w1")]
    path = str(tmp_path_factory.mktemp("index") / "i")
    index.build(spark.createDataFrame(texts, "chunk_ord long, text string").repartition(3)).save(path)
    return index.Index.load(spark, path)


@pytest.mark.parametrize("ids", ["int", "long", "string"])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_blocks_and_join_rank_alike(spark, stored, monkeypatch, ids, k):
    r = random.Random(k)
    queries = spark.createDataFrame([(i, " ".join(r.choices([f"w{j}" for j in range(70)], k=6))) for i in range(30)] + [(90, ""), (91, None), (92, "unknown"), (93, "w0 w0 w1")], "query_id long, query string")
    queries = queries.selectExpr(f"cast(query_id as {ids}) as query_id", "query")
    columns = ["query_id", "chunk_ord", "score", "rank"]
    blocks = index.search(stored, queries, k).select(columns)
    monkeypatch.setattr(index, "CELLS", 1000)  # few queries at once
    few = index.search(stored, queries, k).select(columns)
    monkeypatch.setattr(index, "MOST_QUERY_TERMS", 3)
    joined = index.search(stored, queries, k).select(columns)
    assert sorted(blocks.collect()) == sorted(joined.collect()) == sorted(few.collect())
    assert blocks.schema == joined.schema and blocks.count() > 0


def test_ties_go_to_the_smaller_chunk(spark, stored):
    got = index.search(stored, spark.createDataFrame([(1, "w0 w1")], "query_id long, query string"), 1000).collect()
    same = {r["chunk_ord"]: r["rank"] for r in got if r["chunk_ord"] > 5000}
    assert same[5001] + 1 == same[5002]


def test_no_queries_and_no_chunks(spark, stored):
    none = spark.createDataFrame([], "query_id long, query string")
    assert index.search(stored, none).collect() == [] and index.search(stored, none.union(spark.createDataFrame([(1, "zzz")]))).collect() == []
    empty = spark.createDataFrame([], "chunk_ord long, text string")
    q = spark.createDataFrame([(1, "w0")], "query_id long, query string")
    assert index.search_texts(empty, q).collect() == []
    with pytest.raises(ValueError):
        index.search(stored, q, 0)


def test_settings_rank_where_the_chunks_are(spark, monkeypatch):
    """A grid gives what a search with each of its settings gives, and no row of a pair of query and chunk
    travels for it."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    chunks = spark.createDataFrame([(i, " ".join(r.choices(words, k=r.randint(0, 30)))) for i in range(300)], "chunk_ord long, text string")
    queries = spark.createDataFrame([(i, " ".join(r.choices(words, k=4))) for i in range(9)], "query_id long, query string")
    grid = spark.createDataFrame([("a", 0.9, 0.4), ("b", 2.0, 0.9), ("c", 0.9, 0.4), ("a", 0.9, 0.4)], "name string, k1 double, b double")
    columns = ["name", "k1", "b", "query_id", "chunk_ord", "score", "rank"]
    want = [(name, k1, b, *x) for name, k1, b in (("a", 0.9, 0.4), ("b", 2.0, 0.9), ("c", 0.9, 0.4)) for x in index.search_texts(chunks, queries, 5, k1, b).select(columns[3:]).collect()]
    got = index.search_texts(chunks, queries, 5, grid=grid)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == sorted(want)
    monkeypatch.setattr(index, "MOST_QUERY_TERMS", 3)
    joined = index.search_texts(chunks, queries, 5, grid=grid).select(columns)
    assert sorted(map(tuple, joined.collect())) == sorted(want)


def test_sweep_scores_no_pair_in_a_join(spark, monkeypatch):
    monkeypatch.setattr(index, "_score", lambda *a: pytest.fail("queries and postings met in a join"))
    assert plans.QUERIES["bm25_param_sweep"](spark, SF).count() > 0
