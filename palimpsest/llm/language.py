"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile lists the most frequent n-grams (1 to 3 letters, words padded by a space) of a text in
order. A document's distance to a language is the sum, over its own profile, of how far each n-gram
stands out of its place in the language's profile; n-grams the language lacks count the full length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

LENGTH = 300
#: Labelled documents that profiles are learnt from, about: the classifier's bounded sample.
SAMPLE = 20_000
#: Languages a model may hold; with LENGTH entries each this bounds what is broadcast.
MOST_LANGUAGES = 500
UNDECIDED = "und"
#: Score from which a document belongs to its nearest language. Random letters reach 0.2, languages in
#: other scripts 0, and unlearnt ones in the same script about 0.2; texts of a learnt one 0.45 and more.
LEAST = 0.3

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Code point -> code point of its lower-case letter, or 32 if it is no letter."""
    global _letters
    if _letters is None:
        table = np.full(0x110000, 32, np.int64)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters = table
    return _letters


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram codes ascending, counts) of a whole text; empty if it has no letter."""
    code = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    code = np.concatenate([[32], code, [32]])
    gap = code == 32
    code = code[~(gap & np.concatenate([[False], gap[:-1]]))]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = code[code != 32]
    two = (code[:-1] << 21) | code[1:]
    three = (code[:-2] << 42) | two[1:]
    three = three[code[1:-1] != 32]  # no n-gram reaches over a word's end
    out = np.concatenate([one, two, three])
    out.sort()
    first = np.flatnonzero(np.concatenate([[True], out[1:] != out[:-1]]))
    return out[first], np.diff(np.append(first, len(out)))


def profile(text: str, length: int = LENGTH) -> np.ndarray:
    """The text's most frequent n-grams in order; ties by code."""
    code, count = grams(text)
    if len(code) > length:
        least = np.partition(count, len(count) - length)[len(count) - length]
        keep = count >= least
        code, count = code[keep], count[keep]
    return code[np.argsort(-count, kind="stable")[:length]]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, count) of each batch of texts."""
    for batch in batches:
        parts: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            parts.setdefault(lang, []).append(grams(text.as_py()))
        for lang, found in parts.items():
            code = np.concatenate([c for c, _ in found])
            count = np.concatenate([n for _, n in found])
            if len(code):
                code, at = np.unique(code, return_inverse=True)
                count = np.bincount(at, count).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code, pa.int64()), pa.array(count)], names=["lang", "gram", "n"])


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", length: int = LENGTH, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Profiles of each language of ``labelled``: language -> n-gram codes in order of rank.

    Learnt from about ``sample`` labelled rows (all if there are fewer), chosen by a hash of the text
    and thinned evenly, so that reruns agree. Rows with a null text or label don't count. Only the
    profiles, ``length`` numbers a language, come to the driver.
    """
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    total = rows.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = total.withColumn("r", F.row_number().over(top)).where(F.col("r") <= length)
    out: dict[str, np.ndarray] = {}
    for lang, found in best.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "gram"))).alias("p")).limit(MOST_LANGUAGES + 1).collect():
        out[lang] = np.array([x["gram"] for x in found], np.int64)
    if len(out) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return dict(sorted(out.items()))


class Model:
    def __init__(self, profiles: dict[str, np.ndarray], length: int = LENGTH):
        self.names, self.length = list(profiles), length
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        self.rank = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for k, p in enumerate(profiles.values()):
            self.rank[np.searchsorted(self.codes, p), k] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(text or "", self.length)
        if not len(own) or not self.names:
            return UNDECIDED, 0.0
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        rank = self.rank[at]
        off = np.where(rank < 0, self.length, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(off.argmin())  # ties: the first language by name
        return self.names[best], float(1 - off[best] / (self.length * len(own)))


def _predicted(batches: Iterator[pa.RecordBatch], profiles: dict[str, np.ndarray], length: int) -> Iterator[pa.RecordBatch]:
    model = Model(profiles, length)
    for batch in batches:
        found = [model.predict(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=["id", "lang_pred", "score"])


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: (id, lang_pred, score).

    score is 1 less the share of the greatest possible distance, between 0 and 1. A text that is null
    or has no letter, or a model without languages, gives ``und`` and 0. Ties go to the first language
    by name. Texts of any length are read whole; other columns are ignored. No shuffle.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _predicted(it, profiles, length), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def known_only(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` in a language that the profiles know, labelled by it.

    A row goes if its text is null, has no letter, or is no nearer to any profile than ``least``: a
    language that wasn't learnt, or no language. ``lang_col``, where docs has it, becomes the predicted
    language, so that rows without a label get one. All columns stay, and what is null elsewhere."""
    ship(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    place, label = names.index(text_col), names.index(lang_col) if lang_col in names else None

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(profiles)
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column(place)]
            columns = list(batch.columns)
            if label is not None:
                columns[label] = pa.array([name for name, _ in found], pa.string()).cast(columns[label].type)
            good = pa.array([name != UNDECIDED and score >= least for name, score in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(good)

    return docs.mapInArrow(keep, schema)
