import hashlib
import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import pii, queries
from tests.conftest import SF

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            odd = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
            good = [True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 16 <= len(d) <= 19 and odd % 10 == 0, 8 <= len(d) <= 15][kind]
            if good:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("ab1204.@+- ()é\n%_", max_size=50) | st.from_regex(r"x? ?\+[0-9 ().-]{6,16} 4[0-9]{15} [0-9]{1,3}(\.[0-9]{1,3}){3,5}", fullmatch=True))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_time_stays_in_proportion():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 50_000, "@a" * 50_000):
        pii.base_spans(text)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(1)
    field = pii.Field(rng.standard_normal((pii.FEATURES, len(pii.TAGS))), rng.standard_normal((len(pii.TAGS),) * 2))
    rows = [rng.integers(1, pii.FEATURES, (n, 11)).astype(np.int32) for n in (1, 4, 2, 3)]
    for x, path in zip(rows, field.decode(rows), strict=True):
        score = field.emit[x].sum(axis=1)
        best = max(itertools.product(range(len(pii.TAGS)), repeat=len(x)), key=lambda p: sum(score[i, t] for i, t in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert tuple(path) == best


def examples(n=300, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))

    def card():
        d = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    def value():
        return rng.choice([lambda: f"{word()}.{rng.randint(1, 99)}@{word()}.example.com", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), card, lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", lambda: str(rng.randint(1, 99_999)), lambda: f"{rng.randint(1, 9)}.{rng.randint(1, 99)}"])()

    return [" ".join(word() if rng.random() < 0.8 else value() for _ in range(20)) for _ in range(n)]


def test_field_finds_what_the_patterns_miss(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(examples())], "doc_id long, text string")
    field = pii.learn(df)
    text = "call 1 (415) 555-2671 or mail us"
    assert pii.base_spans(text) == []
    base, every = pii.all_spans(examples(50, 9) + [text], field)
    assert all(set(b) <= set(x) for b, x in zip(base, every, strict=True))
    hits = agree = 0
    for t, b in zip(examples(100, 5), map(pii.base_spans, examples(100, 5)), strict=True):
        found = {(k, s, e) for k, s, e in pii.added_spans([t], [[]], field)[0]}
        hits += len(b)
        agree += len(found & set(b))
    assert agree > 0.8 * hits  # held-out lines: the field recovers the values from shapes alone


def test_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.cc 1.2.3.4 +1 (222) 555-1234", "x"), (3, "a@b.cc 1.2.3.4 +1 (222) 555-1234", "x"), (4, "é" * 50_000 + " 4111 1111 1111 1111", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    field = pii.learn(df.limit(0))
    got = sorted((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["spans"]) for r in pii.personal_data(df, field).collect())
    three = (3, 1, 1, 0, 1, "email:0:6,ip:7:14,phone:15:32")
    assert got == [(1, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, ""), three, three, (4, 0, 0, 1, 0, "card:50001:50020")]
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(df, field).collect()}
    assert clean[1] is None and clean[3] == "[EMAIL] [IP] [PHONE]" and clean[4].endswith(" [CARD]")
    assert pii.personal_data(df.limit(0), field).collect() == []


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in queries.read(spark, SF, "documents").collect()}
    got = queries.op2_crf_pii(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        base = brute(docs[r["doc_id"]] or "")
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == i for b in base) for i in range(4)]
        assert set(text.split(",")) - {""} <= set(r["spans"].split(","))


def test_values_spelt_otherwise_on_held_out_lines(spark):
    """Fails if only the base spans are found: the patterns find none of these values."""
    docs = queries.read(spark, "/root/testdata/sf0.01", "documents")
    field = pii.learn(docs)
    precision, recall, n = pii.held_out_quality(docs, field)
    assert n >= 100 and precision > 0.95 and recall > 0.85


def test_spelling_round_trip():
    line = "write a.b@mail.example.com or +49 301 2345678 from 10.0.0.7 with 4111 1111 1111 1111 now"
    spans = pii.base_spans(line)
    assert [k for k, _, _ in spans] == [0, 1, 2, 3]
    for turn in range(20):
        text, now = pii.respelt(line, spans, turn)
        assert len(now) == 4 and pii.base_spans(text) == []
        assert all(pii.plausible(k, text[s:e]) and pii.whole(k, text, s, e) for k, s, e in now)
    assert pii.spelt_back(0, "a (at) b (dot) c") == "a@b.c"


def test_no_part_of_a_longer_number():
    text = "1111 4111 1111 1111 1111 2"
    assert not pii.whole(2, text, 5, 24) and pii.whole(2, text[5:24], 0, 19)


def test_long_lines_can_be_learnt_from(spark):
    df = spark.createDataFrame([(i, " ".join(["words and words"] * 60 + [t])) for i, t in enumerate(examples(60))], "doc_id long, text string")
    assert any(pii.base_spans(line) for line in pii.sample(df))
