import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.llm import superminhash
from palimpsest.llm._words import shingle_sets


def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows, percent=85):
    ids = [i for i, _ in rows]
    sets = brute_sets([t for _, t in rows])
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for (a, x), (b, y) in itertools.combinations(zip(ids, sets), 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            comp[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in zip(ids, sets)}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([1, 3, 5, 8, 60, 200]))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), rng.choice([" ", "\n", "\t  "]).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n"), (len(rows) + 3, "x " * 30_000)]
    return rows


def test_sets_are_exact():
    texts = [t for _, t in corpus()]
    got = {}
    for lo, hi, h, at in shingle_sets(pa.array(texts), most=500):
        for i in range(lo, hi):
            got[i] = at[i - lo + 1] - at[i - lo]
    assert [got[i] for i in range(len(texts))] == [len(s) for s in brute_sets(texts)]


def test_very_long_text_is_cut_without_effect(monkeypatch):
    text = " ".join(str(i * 7919 % 1000) for i in range(5000))
    whole = [x[2] for x in shingle_sets(pa.array([text]))][0]
    monkeypatch.setattr("palimpsest.llm._words.MOST_AT_ONCE", 4096)
    assert (whole == [x[2] for x in shingle_sets(pa.array([text]))][0]).all()


def test_signature_agreement_estimates_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 54, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 54, 200, dtype=np.uint64)])
    sig = superminhash.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 1000, 2000]), 250)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.12
    one = superminhash.signatures(a[:1], np.array([0, 1]), 125)
    assert sorted((one[0] >> np.uint64(48)).tolist()) == list(range(125))  # one element: a permutation


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "z", 1.5) for i, t in rows], "doc_id long, text string, component string, n double")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in superminhash.near_duplicates(df.repartition(5)).collect()}
    assert got == brute(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [str(rng.random()) for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = str(rng.random())
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in superminhash.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert superminhash.near_duplicates(df).collect() == []
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "a b")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in superminhash.near_duplicates(df).collect())
    assert [x for x in got if x[0]] == [(1, 1), (1, 1), (2, 1)]


def test_columns_of_any_name_stay(spark):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(1, text, "a", True), (2, text, "b", True), (3, "x", "c", False)], "doc_id long, text string, _gone string, kept boolean").withColumn("id", F.lit(5)).withColumn("row", F.lit("r"))
    got = superminhash.deduplicated(df)
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == [(1, text, "a", True, 5, "r"), (3, "x", "c", False, 5, "r")]


def test_rows_that_repeat_an_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (4, "c d")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in superminhash.near_duplicates(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_blocks_equal_all_pairs():
    """Members of one bucket, in components that the leader left apart."""
    import pandas as pd

    rng = random.Random(9)
    rows = []
    for g in range(30):
        base = [rng.getrandbits(50) for _ in range(rng.choice([3, 20, 150]))]
        for _ in range(4):
            s = {x if rng.random() > 0.04 else rng.getrandbits(50) for x in base}
            rows.append(np.array(sorted(s), np.uint64))
    frame = pd.DataFrame({"id": range(len(rows)), "n": [len(x) for x in rows], "component": range(len(rows)), "side": 0, "elements": [x.tobytes() for x in rows], "bands": [np.array([77])] * len(rows)})
    got = superminhash.linked((77, 0, 0), frame, 85)
    def groups(pairs):
        root = list(range(len(rows)))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root
    every = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 100 * len(set(rows[a]) & set(rows[b])) >= 85 * len(set(rows[a]) | set(rows[b]))]
    assert groups(zip(got.a, got.b)) == groups(every) and len(every) > 20
