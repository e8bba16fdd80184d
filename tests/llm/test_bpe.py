import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_vocabulary()
EXACT = tokenizers.Tokenizer.from_file(PATH)
CODER = bpe.Coder(bpe.load(PATH), remembered=500)
SAMPLES = ["", " ", "  ", "a  b", " a", "a ", "don't we'll I'm", "x y 　z", "a \n b", "\x1c a\x1d b \x85", "naïve 数字 12 34567 ½", "aaaaaaaaaaaaaaaa" * 9, "<|endoftext|>a <|endoftext|> b<|endo", "🙂🙂 👩‍👩‍👧", "\t\ttab  \r\n\r\n end  ", "zzz" * 5000, "a​b ᠎ c"]


def ids(text):
    return EXACT.encode(text, add_special_tokens=False).ids


def ours(text):
    return list(memoryview(CODER.encode(text)).cast("I"))


@pytest.mark.parametrize("text", SAMPLES)
def test_samples(text):
    assert ours(text) == ids(text)
    assert CODER.decode(CODER.encode(text)) == EXACT.decode(ids(text), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abc 'sS\n\t.,1é", max_size=60))
def test_any_text(text):
    assert ours(text) == ids(text)


def test_tokens_run_together():
    rng = random.Random(4)
    vocabulary = [b.decode() for b in CODER.whole if b.isascii()]
    for _ in range(2000):
        text = "".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6)))
        assert ours(text) == ids(text)


def test_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(SAMPLES)] + [(99, None, "x"), (99, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encoded(df, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict((a, b) for a, b, _ in rows)[r["doc_id"]] or ""
        raw = b"".join(i.to_bytes(4, "little") for i in ids(text))
        assert (r["n_tokens"], r["ids_sha256"], bytes(r["ids"])) == (len(raw) // 4, hashlib.sha256(raw).hexdigest(), raw)
    assert bpe.encoded(df.limit(0), PATH).collect() == []
