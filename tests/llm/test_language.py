import random
from collections import Counter

from tests.conftest import SF

from palimpsest.llm import language, queries


def brute_profile(text, length=language.LENGTH):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else (c if c.isalpha() else " ") for c in text).split(" ")
    count = Counter()
    for w in (w for w in words if w):
        count.update(w)
    s = " " + " ".join(w for w in words if w) + " "
    count.update(s[i : i + 2] for i in range(len(s) - 1))
    count.update(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " ")
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [code(g) for g, _ in sorted(count.items(), key=lambda x: (-x[1], code(x[0])))][:length] if s.strip() else []


def test_profile_equals_brute_force():
    for text in ["", "..  1", "a", "Der Hund! der HUND läuft\nÉté été İx", "ab " * 4000 + "xyz", "𝒳y z" * 3]:
        assert language.profile(text).tolist() == brute_profile(text)


def test_distance_by_hand():
    model = language.Model({"x": language.profile("aaa bbb"), "y": language.profile("ccc ddd")})
    assert model.predict("aaa bbb") == ("x", 1.0)
    assert model.predict("ccc")[0] == "y"
    assert model.predict(None) == model.predict("12 .") == ("und", 0.0)
    assert 0 <= model.predict("zzz")[1] <= 1


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "the cat", None), (3, "the cat", "en"), (3, "the cat", "en"), (None, "", "fr")], "doc_id long, text string, lang string")
    profiles = language.learn(df)
    assert list(profiles) == ["en"]
    got = language.identify(df, profiles).collect()
    assert sorted((str(r[0]), r[1]) for r in got) == [("1", "und"), ("2", "en"), ("3", "en"), ("3", "en"), ("None", "und")]
    assert language.identify(df.limit(0), language.learn(df.limit(0))).collect() == []
    assert sorted(str(r["doc_id"]) for r in language.known_only(df, profiles).collect()) == ["2", "3", "3"]


def test_held_out_accuracy(spark):
    got = queries.op3_rank_order_language(spark, SF)
    docs = queries.read(spark, SF, "documents").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out and lang is not null").collect()
    right = sum(r["lang_pred"] == r["lang"] for r in rows)
    assert len(rows) > 20 and right / len(rows) > 0.95


def test_other_languages_and_noise_go(spark):
    """Fails if documents are kept for having a letter: only the distance tells these apart."""
    docs = queries.read(spark, SF, "documents").where("lang is not null")
    profiles = queries.language_profiles(docs)
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(80))
    text = docs.where("lang = 'de' and length(text) > 500").first()["text"]
    rows = [(1, noise, None), (2, "Это русский текст, который написан здесь для примера", None), (3, "Bu bir metindir ve burada örnek olarak yazılmıştır, başka bir şey yok", "xx"), (4, text, None), (5, "中文文本没有空格", "de")]
    got = language.known_only(spark.createDataFrame(rows, "doc_id long, text string, lang string"), profiles).collect()
    assert [tuple(r) for r in got] == [(4, text, "de")]
