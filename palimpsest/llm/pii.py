"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field finds what their spelling rules miss: it learns from a
small labelled table, lines of a bounded sample of documents as they are and with their values spelt
otherwise (at signs in brackets or between spaces, cards in groups with dots, national phone numbers,
defanged addresses), and sees only word shapes. Its spans are added where they overlap no base span
and the value, spelt back, passes the kind's own check. Only stretches of words near a digit, an at sign
or a bracketed "at" are decoded: elsewhere no kind can occur.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

KINDS = ("email", "ip", "card", "phone")
# The base patterns. A group that can't gain by giving back is possessive, and a run of
# digits is tried from its start only, so that time stays in proportion to the text.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Lines that the field learns from, at most, and as many with values spelt otherwise: they are the
#: small labelled table. Lines are cut at this length, so that every document can give some.
LINES = 1500
LINE_CHARS = 400
#: Of five parts of all lines, by hash, the first is held out: nothing is learnt from it.
PARTS = 5
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
REACH = 4  # words on either side of a digit or at sign, of 40 characters each on average at most
TRIGGER = re.compile(r"[0-9@]+|[(\[{] ?[Aa][Tt] ?[)\]}]")
FEATURES = 1 << 12
PIECE = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(value: str) -> str:
    return "".join(c for c in value if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = []
    done = 0
    if "@" in text:
        for m in AT.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                done = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def pieces(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: runs of letters, runs of digits, single other signs."""
    found = [m.span() for m in PIECE.finditer(text)]
    at = np.array(found, np.int64).reshape(-1, 2)
    return at[:, 0], at[:, 1]


def stretches(text: str) -> list[tuple[int, int]]:
    """Character ranges, cut between words, within REACH words of a digit or an at sign. A side ends
    after 40 * REACH characters, inside a word if need be: the field's features reach three words."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        lo, hi = m.start(), m.end()
        for _ in range(REACH):  # white space bounds a step outwards
            while lo > 0 and not text[lo - 1].isspace() and m.start() - lo < 40 * REACH:
                lo -= 1
            while hi < len(text) and not text[hi].isspace() and hi - m.end() < 40 * REACH:
                hi += 1
            lo, hi = max(0, lo - 1), min(len(text), hi + 1)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def shape_features(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, 11) feature numbers below FEATURES: shapes of the word and its neighbours."""
    n = len(starts)
    code = np.zeros(n, np.int64)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        c = text[s]
        if c in "0123456789":
            code[i] = 1 + min(e - s, 20)  # digits by length
        elif c.isalpha():
            code[i] = 24 + min(e - s, 4) + (5 if c.isupper() else 0)  # letters by length and case
        else:
            code[i] = 40 + (ord(c) if ord(c) < 128 else 0)
    spaced = np.ones(n, np.int64)
    spaced[1:] = starts[1:] > ends[:-1]
    pad = np.concatenate([[0, 0, 0], code * 2 + spaced, [0, 0, 0]])
    near = [pad[3 + k : 3 + k + n] for k in range(-3, 4)]
    parts = [near[3], near[2], near[4], near[1], near[5], near[0], near[6], near[2] * 512 + near[3], near[3] * 512 + near[4], near[1] * 512 + near[2], near[4] * 512 + near[5]]
    out = np.stack([(p * 2654435761 + 97 * (k + 1) * 40503) % (1 << 31) >> 7 for k, p in enumerate(parts)], axis=1)
    return (out % (FEATURES - 1) + 1).astype(np.int32)


def tagged(text: str, starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(len(starts), np.int64)
    for kind, s, e in spans:
        inside = np.flatnonzero((starts >= s) & (ends <= e))
        tags[inside] = 2 + 2 * kind
        if len(inside):
            tags[inside[0]] = 1 + 2 * kind
    return tags


class Field:
    """Weights of a linear-chain CRF; feature 0 is padding and weighs nothing."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    @staticmethod
    def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(r) for r in rows])
        out = np.zeros((len(rows), int(size.max()), rows[0].shape[1]), np.int32)
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return out, size

    @classmethod
    def train(cls, features: list[np.ndarray], tags: list[np.ndarray], epochs: int = 60, rate: float = 0.3, decay: float = 1e-4) -> Field:
        """Maximum likelihood by full-batch gradient steps (Adam), deterministic. Equal stretches count
        once with their number as weight, and stretches of similar length are computed together."""
        k = len(TAGS)
        emit, move = np.zeros((FEATURES, k)), np.zeros((k, k))
        if not features:
            emit[:, 0] = 1.0
            return cls(emit, move)
        count: dict[tuple[bytes, bytes], int] = {}
        for x, y in zip(features, tags, strict=True):
            key = (x.tobytes(), y.astype(np.int64).tobytes())
            count[key] = count.get(key, 0) + 1
        width = features[0].shape[1]
        rows = sorted(((np.frombuffer(x, np.int32).reshape(-1, width), np.frombuffer(y, np.int64), n) for (x, y), n in count.items()), key=lambda r: len(r[0]))
        cuts = np.searchsorted([len(r[0]) for r in rows], [8, 16, 32, 64, 128, 256], side="right")
        buckets, gold, gold_move, total = [], np.zeros_like(emit), np.zeros_like(move), 0
        for part in (rows[s:e] for s, e in zip([0, *cuts], [*cuts, len(rows)], strict=True) if e > s):
            x, size = cls._padded([r[0] for r in part])
            y = np.zeros(x.shape[:2], np.int64)
            for i, r in enumerate(part):
                y[i, : len(r[1])] = r[1]
            live = (np.arange(x.shape[1])[None] < size[:, None]) * np.array([r[2] for r in part], np.float64)[:, None]
            buckets.append((x, size, live))
            total += live.sum()
            for f in range(width):
                np.add.at(gold, (x[..., f].ravel(), y.ravel()), live.ravel())
            np.add.at(gold_move, (y[:, :-1].ravel(), y[:, 1:].ravel()), live[:, 1:].ravel())
        state = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
        for step in range(1, epochs + 1):
            g_emit, g_move, pace = -gold, -gold_move, np.exp(move)
            for x, size, live in buckets:
                b, t, _ = x.shape
                score, on = emit[x].sum(axis=2), live[..., None] > 0
                up, down = np.zeros((b, t, k)), np.zeros((b, t, k))
                up[:, 0] = score[:, 0]
                for i in range(1, t):
                    top = up[:, i - 1].max(axis=1, keepdims=True)
                    up[:, i] = np.where(on[:, i], np.log(np.exp(up[:, i - 1] - top) @ pace) + top + score[:, i], up[:, i - 1])
                for i in range(t - 2, -1, -1):
                    z = score[:, i + 1] + down[:, i + 1]
                    top = z.max(axis=1, keepdims=True)
                    down[:, i] = np.where(on[:, i + 1], np.log(np.exp(z - top) @ pace.T) + top, 0.0)
                last = up[np.arange(b), size - 1]
                top = last.max(axis=1, keepdims=True)
                norm = (top + np.log(np.exp(last - top).sum(axis=1, keepdims=True)))[:, None]
                p = (np.exp(up + down - norm) * live[..., None]).reshape(-1, k)
                flat = x.reshape(-1)
                for j in range(k):
                    g_emit[:, j] += np.bincount(flat, np.repeat(p[:, j], width), FEATURES)
                high = up[:, :-1].max(axis=2, keepdims=True)
                after = np.exp(score[:, 1:] + down[:, 1:] - norm + high) * live[:, 1:, None]
                g_move += (np.exp(up[:, :-1] - high).reshape(-1, k).T @ after.reshape(-1, k)) * pace
            g_emit[0] = 0
            for w, g, m, v in ((emit, g_emit, state[0], state[1]), (move, g_move, state[2], state[3])):
                g = g / total + decay * w
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(emit, move)

    def decode(self, features: list[np.ndarray], cells: int = 1 << 16) -> list[np.ndarray]:
        """Viterbi paths of many stretches, in batches of similar length."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(features)
        order = sorted(range(len(features)), key=lambda i: len(features[i]))
        order = [i for i in order if len(features[i])]
        while order:
            take = 1
            while take < len(order) and (take + 1) * len(features[order[take]]) <= cells and len(features[order[take]]) <= 2 * len(features[order[0]]) + 8:
                take += 1
            now, order = order[:take], order[take:]
            x, size = self._padded([features[i] for i in now])
            b, t, _ = x.shape
            score = self.emit[x].sum(axis=2)
            back = np.zeros((b, t, len(TAGS)), np.int8)
            best = score[:, 0]
            for i in range(1, t):
                z = best[:, :, None] + self.move
                back[:, i] = z.argmax(axis=1)
                nxt = z.max(axis=1) + score[:, i]
                best = np.where((i < size)[:, None], nxt, best)
            at = best.argmax(axis=1)
            path = np.zeros((b, t), np.int64)
            for i in range(t - 1, -1, -1):
                path[:, i] = at
                at = np.where(i < size, back[np.arange(b), i, at], at) if i else at
            for row, i in enumerate(now):
                out[i] = path[row, : size[row]]
        return out


SPELT_AT = re.compile(r" ?[(\[{] ?at ?[)\]}] ?| ?@ ?", re.I)
SPELT_DOT = re.compile(r" ?[(\[{] ?(?:dot|\.) ?[)\]}] ?| ?\. ?", re.I)
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NATIONAL = re.compile(r"(?:\+|\(?0[0-9]|1?[ .-]?\()[0-9 ()./-]*[0-9]")


def spelt_back(kind: int, value: str) -> str:
    """A value in the spelling of the patterns."""
    if kind == 0:
        return SPELT_DOT.sub(".", SPELT_AT.sub("@", value))
    if kind == 1:
        return SPELT_DOT.sub(".", value)
    return value


def plausible(kind: int, value: str) -> bool:
    """The kind's own check of a value that the field found."""
    value = spelt_back(kind, value)
    d = _digits(value)
    if kind == 0:
        return ADDRESS.fullmatch(value) is not None
    if kind == 1:
        parts = value.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 16 <= len(d) <= 19 and luhn(d) and not any(c.isalpha() for c in value)
    return 9 <= len(d) <= 15 and len(d) < len(value) and NATIONAL.fullmatch(value) is not None


def whole(kind: int, text: str, lo: int, hi: int) -> bool:
    """No part of a longer run of digits: such a run is another kind of number."""
    gap = " .-/_" if kind == 2 else ".-/" if kind == 3 else ""
    left, right = text[max(0, lo - 2) : lo], text[hi : hi + 2]
    digit = lambda c: c in "0123456789"
    if left and (digit(left[-1]) or (left[-1] in gap and len(left) > 1 and digit(left[-2]))) and digit(text[lo]):
        return False
    return not (right and (digit(right[0]) or (right[0] in gap and len(right) > 1 and digit(right[1]))) and digit(text[hi - 1]))


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """What the field adds to the base spans of each text."""
    where, features = [], []
    for i, text in enumerate(texts):
        for lo, hi in stretches(text):
            part = text[lo:hi]
            s, e = pieces(part)
            where.append((i, s + lo, e + lo))
            features.append(shape_features(part, s, e) if len(s) else np.zeros((0, 11), np.int32))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, s, e), tags in zip(where, field.decode(features), strict=True):
        k = 0
        while k < len(tags):
            if tags[k]:
                kind, first = (int(tags[k]) - 1) // 2, k
                k += 1
                while k < len(tags) and tags[k] == 2 + 2 * kind:
                    k += 1
                lo, hi = int(s[first]), int(e[k - 1])
                if plausible(kind, texts[i][lo:hi]) and whole(kind, texts[i], lo, hi) and all(hi <= a or b <= lo for _, a, b in base[i]):
                    out[i].append((kind, lo, hi))
            else:
                k += 1
    return out


def spellings(kind: int, value: str) -> list[str]:
    """Other spellings of a value that the patterns found; they find none of these whole."""
    if kind == 0:
        local, _, domain = value.partition("@")
        return [f"{local} @ {domain}", f"{local} (at) {domain}", f"{local}[at]{domain.replace('.', '[dot]')}", f"{local} (at) {domain.replace('.', ' (dot) ')}"]
    if kind == 1:
        return [value.replace(".", "[.]"), value.replace(".", " . ")]
    d = _digits(value)
    if kind == 2:
        groups = [d[i : i + 4] for i in range(0, len(d), 4)]
        return [sign.join(groups) for sign in (".", "/", "_", "  ")]
    rest = d[2:] if len(d) > 10 else d[1:]
    if len(rest) < 8:
        return []
    a, b = rest[:3], rest[3:]
    return [f"0{a[:2]} {a[2]}{b}", f"(0{a}) {b[:3]}-{b[3:]}", f"0{a}/{b}", f"0{a}.{b[:3]}.{b[3:]}", f"0{a}-{b}"]


def respelt(line: str, spans: list[tuple[int, int, int]], turn: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The line with each value in its ``turn``-th other spelling, and where those stand now."""
    out, now, at = [], [], 0
    for kind, s, e in sorted(spans, key=lambda x: x[1:]):
        other = spellings(kind, line[s:e])
        if s < at or not other:
            continue
        out.append(line[at:s])
        lo = sum(map(len, out))
        out.append(other[turn % len(other)])
        now.append((kind, lo, lo + len(out[-1])))
        at = e
    return "".join([*out, line[at:]]), now


def sample(docs: DataFrame, text_col: str = "text", lines: int = LINES, held_out: bool = False) -> list[str]:
    """At most ``lines`` lines of ``docs`` that hold a digit or an at sign, those with the smallest
    hashes. Half of them at most look as if they held a value, so that other numbers are learnt too."""
    text = F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(rf"[^\n]{{1,{LINE_CHARS}}}"), F.lit(0))
    rows = docs.select(F.explode(text).alias("line")).where(F.col("line").rlike("[0-9@]")).withColumn("h", F.xxhash64("line"))
    rows = rows.where((F.pmod("h", F.lit(PARTS)) == 0) == F.lit(held_out))
    likely = F.col("line").rlike(r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]|[0-9]([ -]?[0-9]){12}|\+[0-9]")
    found = []
    for part in (rows.where(likely), rows.where(~likely)):
        found += [r["line"] for r in part.select("h", "line").distinct().orderBy("h", "line").limit(lines // 2).collect()]
    return found


def examples(lines: list[str], most: int = LINES) -> tuple[list, list]:
    """(lines with their base spans, lines with values spelt otherwise and their spans)."""
    plain = [(line, base_spans(line)) for line in lines]
    holding = [x for x in plain if x[1]]
    turns = min(20, most // max(1, len(holding)))
    other = [respelt(line, spans, i + turn) for turn in range(turns) for i, (line, spans) in enumerate(holding)]
    return plain, [x for x in other if x[1]][:most]


def learn(docs: DataFrame, text_col: str = "text", lines: int = LINES) -> Field:
    """A field trained on at most ``lines`` lines of ``docs`` as they are, and half as many with other
    spellings. The labelled table is small by its parameter; nothing else comes to the driver. Without
    any value in the sample the field adds nothing."""
    plain, other = examples(sample(docs, text_col, lines), lines // 2)
    features, tags = [], []
    for line, spans in plain + other:
        for lo, hi in stretches(line):
            part = line[lo:hi]
            s, e = pieces(part)
            if len(s):
                features.append(shape_features(part, s, e))
                tags.append(tagged(part, s, e, [(k, a - lo, b - lo) for k, a, b in spans]))
    return Field.train(features, tags)


def held_out_quality(docs: DataFrame, field: Field, text_col: str = "text", lines: int = LINES) -> tuple[float, float, int]:
    """(precision, recall, number) of the field's spans on held-out lines whose values are spelt so that
    the patterns miss them. Values that the patterns still find in part don't count."""
    plain, other = examples(sample(docs, text_col, lines, held_out=True), lines)
    other = [x for x in other if not base_spans(x[0])]
    texts = [t for t, _ in other] + [t for t, spans in plain if not spans]
    found = added_spans(texts, [base_spans(t) for t in texts], field)
    want = [set(spans) for _, spans in other] + [set()] * (len(texts) - len(other))
    right, all_found, all_wanted = sum(len(set(f) & w) for f, w in zip(found, want, strict=True)), sum(map(len, found)), sum(map(len, want))
    return right / max(1, all_found), right / max(1, all_wanted), all_wanted


def all_spans(texts: list[str], field: Field) -> tuple[list, list]:
    base = [base_spans(t) for t in texts]
    return base, [sorted(b + more) for b, more in zip(base, added_spans(texts, base, field), strict=True)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _found(batches: Iterator[pa.RecordBatch], emit: np.ndarray, move: np.ndarray) -> Iterator[pa.RecordBatch]:
    field = Field(emit, move)
    for batch in batches:
        for lo in range(0, len(batch), 512):
            part = batch.slice(lo, 512)
            base, every = all_spans([t or "" for t in part.column(1).to_pylist()], field)
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in range(len(KINDS))]
            sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, sha, pa.array([joined(x) for x in every], pa.string())], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, n_email, n_ip, n_card, n_phone, base_sha256, spans).

    The counts and the digest are those of the base spans; spans also holds what the field adds, as
    kind:start:end in code points, end exclusive, by kind, then start. Null texts count as empty.
    Texts are read whole; repeated rows give repeated rows; other columns are ignored. No shuffle.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    emit, move = field.emit.astype(np.float32), field.move.astype(np.float32)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(lambda it: _found(it, emit, move), f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, overlapping ones as one, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, field: Field, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in the text and the length column, if any, renewed.
    Rows without personal data stay as they are; null texts stay null."""
    ship(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    emit, move = field.emit.astype(np.float32), field.move.astype(np.float32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, place = Field(emit, move), names.index(text_col)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                texts = part.column(place).to_pylist()
                _, every = all_spans([t or "" for t in texts], f)
                columns = list(part.columns)
                columns[place] = pa.array([t if t is None else redact(t, s) for t, s in zip(texts, every, strict=True)], columns[place].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(work, schema)
    if length_col in names:
        kind = schema[length_col].dataType
        out = out.withColumn(length_col, F.length(text_col).cast(kind))
    return out
