import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import manifest, queries
from tests.conftest import SF

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def low(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(digests, fan):
    """(root, for each digest its path of (place, run))"""
    at, paths, level = list(range(len(digests))), [[] for _ in digests], digests
    while len(level) > 1:
        runs = [level[i : i + fan] for i in range(0, len(level), fan)]
        for k, i in enumerate(at):
            paths[k].append((i % fan, runs[i // fan]))
        level, at = [sha(*r) for r in runs], [i // fan for i in at]
    return level[0], paths


def brute(rows, fan=16):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    out, roots = [], {}
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        roots[s] = tree([x[2] for x in by[s]], fan)
    root, tops = tree([roots[s][0] for s in names], fan)
    for k, s in enumerate(names):
        for (_, _, digest, r), path in zip(by[s], roots[s][1], strict=True):
            path = path + tops[k]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            acc = leaf((*r[:4], low(r[4]))) if hit else digest
            for at, run in path:
                acc = sha(*run[:at], acc, *run[at + 1 :])
            out.append((r[0], digest, roots[s][0], root, sha(*[d for at, run in path for i, d in enumerate(run) if i != at]), acc, acc == root))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in queries.read(spark, SF, "documents").select(*manifest.FIELDS).collect()]
    got = queries.op13_merkle_manifest(spark, SF)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = got.collect()
    assert order(got) == order(brute(rows))
    assert 0 < sum(not r["verified"] for r in got) < len(got) / 3


@pytest.mark.parametrize(("fan", "digits"), [(3, 2), (16, 3)])
def test_heights_blocks_and_many_sources(spark, fan, digits):
    sizes = [1, 2, 3, 4, 5, 8, 9, 16, 17, 33, 70]
    rows = [(i * 7919 % 100_003, f"s{k}" if k else None, "en", i, f"Text {i}") for k, n in enumerate(sizes) for i in range(1000 * k, 1000 * k + n)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = order(brute(rows, fan))
    assert order(manifest.verified(df.repartition(5), fan=fan, digits=digits).collect()) == want
    assert order(manifest.verified(df.coalesce(1), fan=fan, digits=digits).collect()) == want


def test_a_hot_source_over_several_blocks(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 40}", None, None, None) for i in range(9000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert order(manifest.verified(df).collect()) == order(brute(rows))


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None),
        (None, None, None, None, ""),
        (1, "é", "EN", -5, "ÀÉ ABC z"),
        (1, "é", "EN", -5, "ÀÉ ABC z"),  # a repeated row
        (1, "é", "EN", -5, "other text of the same id"),
        (-7, "", "", 0, "-"),
        (5, "z", "en", 1, "Long Text " * 200_000),
    ]
    df = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], SCHEMA + ", rank int, tree string, path string, part string")
    assert order(manifest.verified(df).collect()) == order(brute(rows))
    assert manifest.verified(df.limit(0)).collect() == []


def test_proofs_check_out_without_the_table(spark):
    df = queries.read(spark, SF, "documents")
    m = manifest.manifest(df)
    ok = m.select((manifest.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), (F.col("seen") == F.col("leaf")).alias("same"))
    assert ok.where("not ok or not same").count() == 0
    assert m.select("root").distinct().count() == 1
