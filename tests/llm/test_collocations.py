import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import collocations, queries
from tests.conftest import SF

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut"]


def brute(rows, least, top, most=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 100 * counts[p[i:j]]}
        found = []
        for p, a in candidates.items():
            if p not in inner:
                cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                s, k = min(cuts)
                found.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], k))
        for rank, (s, a, p, left, right, k) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s, k))
    return sorted(out)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def made(seed, n, words=30):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Été", "a-b", "x'y", "É"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda: "".join(w + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "! ", " : "]) for w in r.choices(vocabulary, weights, k=r.randint(0, 60)))
    return [(r.choice(["en", "de", None]), r.choice([text(), text().upper(), "a fixed phrase of seven words here. " + text()])) for _ in range(n)]


def test_query(spark):
    rows = [tuple(r) for r in queries.read(spark, SF, "documents").select("lang", "text").collect()]
    assert rows_of(queries.op11_automata_collocations(spark, SF)) == brute(rows, 100, 2000)


@pytest.mark.parametrize(("least", "top", "shard", "parts"), [(2, 50, 300, 3), (5, 2000, 1 << 20, 5)])
def test_equals_brute_force(spark, least, top, shard, parts):
    rows = made(least, 260)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(parts)
    assert rows_of(collocations.collocations(df, least=least, top=top, shard=shard)) == brute(rows, least, top)


def test_odd_rows(spark):
    rows = [
        (None, None), ("en", ""), ("en", None), ("en", " \t\n.,;"), ("und", "one two"), (None, "ONE two"), ("en", "x y " * 3000 + "end. " + "p q r s t u " * 500),
        ("en", "same row again"), ("en", "same row again"), ("", "empty lang here"), ("", "empty lang here"), ("en", "." * 4000 + "x y"),
    ]
    df = spark.createDataFrame([(*r, 1, "k", 3) for r in rows], "lang string, text string, rank int, phrase string, n int")
    assert rows_of(collocations.collocations(df, least=2, shard=512)) == brute(rows, 2, 2000)
    assert collocations.collocations(df.limit(0)).collect() == []
    assert collocations.collocations(df.where("text is null")).collect() == []


def test_union_adds_weights_of_equal_paths(spark):
    full = np.full(collocations.BITS // 8, 255, np.uint8)
    batch = lambda texts: pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    made = [b for t in (["a b c d", "b c a b"], ["a b c", "x y"], ["a b c d e f"]) for b in collocations.transducers(iter([batch(t)]), full, full, 1, 1 << 20, 5)]
    found = {}
    for out in collocations.united(iter(made), 1):
        found.update({p: (f, x) for p, f, x in zip(out.column(1).to_pylist(), out.column(3).to_pylist(), out.column(4).to_pylist(), strict=True)})
    assert found["a b"] == (4, []) and found["a b c"] == (3, [4]) and found["a b c d"] == (2, [4, 3]) and found["a b c d e"] == (1, [4, 3, 2])
    assert found["x y"] == (1, []) and "d a" not in found and len(found) == 19


def test_scores_are_exact_past_64_bits(spark):
    big = [(10**13 - 1, 10**13 + 7, 10**6 + 3, 10**7 + 9), (10**12 + 1, 10**14 + 3, 10**12 + 7, 10**12 + 9), (100, 400_000, 100, 100)]
    df = spark.createDataFrame(big, "a long, n long, l long, r long")
    got = df.select("*", collocations.score(df.a, df.n, df.l, df.r).alias("s")).collect()
    assert all(r["s"] == 1000 * r["a"] * r["n"] // (r["l"] * r["r"]) for r in got)
