import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import packing, queries
from palimpsest.llm._words import utf8
from tests.conftest import SF

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def coder():
    return packing.Encoder(packing.default_vocabulary())


def raw_ids(ids):
    return np.array(ids, np.uint32).tobytes()


def check(tokenizer, rows, got, length=packing.LENGTH):
    """The contract: pieces cover each document once, sequences are gapless, full or powers of two."""
    want = Counter()
    for i, text in rows:
        want[i, raw_ids([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END])] += 1
    texts = {}
    for (i, ids), n in want.items():
        texts.setdefault(i, []).append((ids, n))
    by_id, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert r["length"] > 0
    assert set(by_id) == set(texts)
    for i, pieces in by_id.items():
        assert sum(r["length"] for r in pieces) == sum(n * len(ids) // 4 for ids, n in texts[i])
        for r in pieces:
            s, e = 4 * r["start"], 4 * (r["start"] + r["length"])
            fit = [ids for ids, _ in texts[i] if len(ids) == 4 * r["doc_tokens"] and zlib.crc32(ids[s:e]) == r["ids_crc32"]]
            assert fit
        starts = Counter((r["doc_tokens"], r["start"]) for r in pieces)
        assert starts[min(starts)] >= 1 and sum(n for (_, s), n in starts.items() if s == 0) == sum(n for _, n in texts[i])
    for s, runs in by_sequence.items():
        at = 0
        for r in sorted(runs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length and at & (at - 1) == 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(1 for runs in by_sequence.values() if sum(r["length"] for r in runs) < length) <= length.bit_length()


def test_query(spark, tokenizer):
    docs = queries.read(spark, SF, "documents")
    got = queries.op12_hilbert_packing(spark, SF)
    assert got.columns == COLUMNS
    check(tokenizer, [tuple(r) for r in docs.select("doc_id", "text").collect()], got.collect())


def test_does_not_depend_on_partitions(spark):
    docs = queries.read(spark, SF, "documents")
    one = sorted(map(tuple, packing.packing(spark, docs.coalesce(1)).collect()))
    assert one == sorted(map(tuple, packing.packing(spark, docs.repartition(7)).collect()))


def test_odd_rows(spark, tokenizer):
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (4, "one"), (None, "no id"), (5, "word " * 30_000),
        (6, "<|endoftext|> and <|STARTOFTEXT|> and <|startoftext|>x"), (7, "x" * 5000), (8, "Étude, it's 3,5÷×… don't 'Tis"),
    ]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, n long, key string, part long")
    check(tokenizer, rows, packing.packing(spark, df).collect())
    assert packing.packing(spark, df.limit(0)).collect() == []
    check(tokenizer, [(i, t) for i, t in rows], packing.packed(df, length=64).withColumn("ids_crc32", F.crc32("ids")).collect(), 64)


def test_sequences_hold_the_ids(spark, tokenizer):
    rows = [(i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma", "delta"], k=i * 7 % 90))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seq = packing.sequences(packing.packed(df, length=128)).collect()
    all_ids = sum((tokenizer.encode(t, add_special_tokens=False).ids + [packing.END] for _, t in rows), [])
    found = np.frombuffer(b"".join(bytes(r["ids"]) for r in sorted(seq, key=lambda r: r["sequence_id"])), np.uint32).tolist()
    assert Counter(found) == Counter(all_ids) and all(len(r["ids"]) == 4 * r["length"] for r in seq)


PARTS = ["word", "Éa", "été", "'s", "'", "don't", ",", "...", "<|", "|>", "endoftext", "<|endoftext|>", "1", "23", " ", "  ", "\n", "\x0b", "\x1f", " ", " ", "é", "́", "İ", "ß", "Σς", "÷", "×", "ñ", "漢字", "̸", "<", "=", "🙂", "ﬁ", "­"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=6))
def test_ids_equal_the_library(tokenizer, coder, texts):
    import pyarrow as pa

    raw, starts, ends = utf8(pa.array(texts, pa.string()))
    plain = [not any(t in x for t in coder.added) for x in texts]
    if all(plain):
        flat, at = coder.many(raw[starts[0] : ends[-1]], starts - starts[0])
        for k, x in enumerate(texts):
            assert flat[at[k] : at[k + 1]].tolist() == tokenizer.encode(x, add_special_tokens=False).ids
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    out = next(packing.encoded(iter([batch]), packing.default_vocabulary(), 2))
    for k, x in enumerate(texts):
        assert np.frombuffer(out.column(4)[k].as_py(), np.uint32).tolist() == [*tokenizer.encode(x, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_the_curve_visits_every_cell_and_steps_to_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
    key = packing.hilbert(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_on_the_curve_are_alike(spark):
    pools = [[f"{a}{b}{c}" for b in "aeiou" for c in "lmnrst"] for a in "bdfgkp"]
    rows = [(i, " ".join(random.Random(i).choices(pools[i % 6], k=200))) for i in range(300)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), length=2048).orderBy("sequence_id", "offset").select("doc_id").collect()
    kinds = [r["doc_id"] % 6 for r in got]
    assert sum(a == b for a, b in zip(kinds, kinds[1:], strict=False)) > 0.8 * len(kinds)


@pytest.mark.parametrize("total", [0, 1, 4096, 4097, 8191, 12_345])
def test_tails(total):
    ends = [*packing.tails(total, 4096), total]
    sizes = [b - a for a, b in zip(ends, ends[1:], strict=False)]
    assert sum(sizes) == total % 4096 and all(s & (s - 1) == 0 for s in sizes)
