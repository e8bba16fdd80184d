import numpy as np

from palimpsest.llm import hyperplane


def brute(rows, threshold=0.98):
    n = len(rows)
    links, comp = [0] * n, {r[0]: r[0] for r in rows}

    def good(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            (ia, va, la), (ib, vb, lb) = rows[a], rows[b]
            if la is None or la != lb or not good(va) or not good(vb) or len(va) != len(vb):
                continue
            x, y = np.array(va, np.float64), np.array(vb, np.float64)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = find(ia), find(ib)
                comp[max(p, q)] = min(p, q)
    return {r[0]: (links[i], find(r[0]), find(r[0]) == r[0]) for i, r in enumerate(rows)}


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(40):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 9)):
            v = (base + 0.07 * rng.standard_normal(16)).astype(np.float32).tolist()
            rows.append((len(rows), v, int(g % 3)))
            if rng.random() < 0.2:
                rows.append((len(rows), v, int(g % 3)))
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [None] + [1.0] * 15, 0), (n + 4, [float("nan")] + [1.0] * 15, 0), (n + 5, rows[0][1], None), (n + 6, [2.0 * x for x in rows[0][1]], 0), (n + 7, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in hyperplane.near_vectors(df, block=4).collect()}
    assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hyperplane.near_vectors(df).collect() == []


def test_bits_grow_with_the_label(spark):
    """A label of many vectors has more bits and more tables than a small one, and loses no link."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(150):
        base = rng.standard_normal(16)
        for _ in range(3):
            rows.append((len(rows), (base + 0.05 * rng.standard_normal(16)).tolist(), int(g % 10 == 0)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in hyperplane.near_vectors(df, bits=2, per_sign=4).collect()}
    assert got == brute(rows)
    assert [hyperplane.tables_for(b, 0.98) for b in (10, 14, 20)] == [14, 20, 32]
