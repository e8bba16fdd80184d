import hashlib
from collections import Counter

import corpus_pipeline
from palimpsest.llm import bpe, language, mixing, pii, superminhash
from palimpsest.llm.queries import language_profiles, read
from tests.conftest import SF
from tests.llm.test_superminhash import brute


def test_stages_equal_brute_force(spark):
    """Each stage against a plain computation on its own input."""
    docs = read(spark, SF, "documents")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}

    one = corpus_pipeline.identify_language(spark, docs, SF)
    model = language.Model(language_profiles(docs))
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == {i for i, r in rows.items() if model.predict(r["text"])[0] != "und"}
    assert {i for i, r in rows.items() if any(c.isalpha() for c in r["text"] or "")} == {r["doc_id"] for r in one.collect()}

    two = corpus_pipeline.near_dedup(spark, one, SF)
    want = brute([(r["doc_id"], r["text"]) for r in one.collect()])
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == {i for i, x in want.items() if x[2]}

    three = corpus_pipeline.personal_data(spark, two, SF)
    field = pii.learn(two)
    assert three.columns == columns
    for r in three.collect():
        text = rows[r["doc_id"]]["text"]
        assert r["text"] == pii.redact(text, pii.all_spans([text], field)[1][0]) and r["n_chars"] == len(r["text"])
        assert pii.base_spans(r["text"]) == []

    four = corpus_pipeline.mix_sources(spark, three, SF)
    copies = {r["doc_id"]: r["copies"] for r in mixing.copies(three).collect()}
    assert four.columns == columns and Counter(r["doc_id"] for r in four.collect()) == Counter({i: n for i, n in copies.items() if n})

    five = corpus_pipeline.tokenize(spark, four, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in three.collect()}
    coder = bpe.Coder(bpe.load(bpe.default_vocabulary()))
    assert len(five) == four.count()
    for r in five:
        assert coder.decode(bytes(r["ids"])) == texts[r["doc_id"]] and r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "en", None, None), (2, "", None, "a", 0), (3, "only words here", "en", None, 15), (3, "only words here", "en", None, 15), (4, "12 .", "en", "a", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    for d in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, SF)
        assert {r["doc_id"] for r in d.collect()} <= {3}
    assert superminhash.deduplicated(df).count() == 5
