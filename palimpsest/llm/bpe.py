"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a pretoken's bytes there is exactly one token that ends the BPE encoding of that
prefix. The automaton lists the vocabulary entries that are suffixes of the prefix; the longest of
them that is compatible with the last token of the remaining prefix is that token. Following the
stored back-pointers from the end gives exactly the ids that the merge procedure gives.

Two tokens are compatible if no merge across their border could have happened before each of them
was complete. That is read off the merge ranks along the right edge of the first token's merge tree
and the left edge of the second's.

The vocabulary file is read once on the driver and broadcast: its size is fixed by the file.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ._words import BASE, spans, utf8

#: Fixed value: the pattern by which byte-level tokenizers of this kind split a text.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of each half of a worker's memory of pretokens.
REMEMBERED = 120_000
#: Places of the table of pairs, pretokens that are encoded together, and the length from which one is
#: encoded on its own and not remembered.
PAIR_BITS, WORDS_AT_ONCE, LONG = 20, 1 << 14, 64
BETWEEN = chr(256)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in such vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """The parts of a tokenizer file that encoding needs, as plain values."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, symbols = file["model"], byte_symbols()
    if file.get("normalizer") or model["type"] != "BPE" or model.get("ignore_merges") or (file["pre_tokenizer"] or {}).get("type") != "ByteLevel" or file["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("only byte-level BPE without normalizer and prefix space")
    raw = lambda token: bytes(symbols[c] for c in token)
    ids = {raw(t): i for t, i in model["vocab"].items() if all(c in symbols for c in t)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = [(raw(a), raw(b)) for a, b in merges]
    added = [(t["content"], t["id"]) for t in file.get("added_tokens", [])]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in file.get("added_tokens", [])):
        raise ValueError("only plain added tokens")
    return {"ids": ids, "merges": merges, "added": added}


class Coder:
    """Encodes and decodes whole texts; holds bounded memories only."""

    def __init__(self, vocabulary: dict, remembered: int = REMEMBERED):
        ids, merges = vocabulary["ids"], vocabulary["merges"]
        self.remembered = remembered
        self.bytes_of = {i: b for b, i in ids.items()}
        #: id -> (left id, right id, rank) of the merge that makes it; None for single bytes
        self.made: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        usable = {ids[bytes([b])] for b in range(256) if bytes([b]) in ids}
        for r, (a, b) in enumerate(merges):
            pair = (ids[a], ids[b])
            self.rank.setdefault(pair, r)
            self.made.setdefault(ids[a + b], (*pair, r))
        self.pairs: dict[int, bool] = {}
        # a token counts only if the merge procedure turns its own bytes into it
        for token, (a, b, r) in sorted(self.made.items(), key=lambda x: x[1][2]):
            if a in usable and b in usable and self._uncrossed(a, b, r):
                usable.add(token)
        self.automaton = ahocorasick.Automaton()
        for token in usable:
            self.automaton.add_word(self.bytes_of[token].decode("latin-1"), token)
        self.automaton.make_automaton()
        self.size_of = [len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)]
        self.whole = {self.bytes_of[t]: t for t in usable}
        self.added = dict(vocabulary["added"])
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.decoding = self.bytes_of | {i: t.encode() for t, i in vocabulary["added"]}
        self.pretokens = regex.compile(PRETOKEN)
        # the memory has a newer and an older half, so that frequent entries outlive a change
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.pair_key, self.pair_ok = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.size_of_token = np.array(self.size_of, np.int64)
        most = max(self.decoding, default=0) + 1
        self.length_of = np.array([len(self.decoding.get(i, b"")) for i in range(most)], np.int64)
        self.start_of = np.cumsum(self.length_of) - self.length_of
        self.all_bytes = np.frombuffer(b"".join(self.decoding.get(i, b"") for i in range(most)), np.uint8)

    def _uncrossed(self, a: int, b: int, before: int) -> bool:
        """No merge across the border of a and b happens earlier than rank ``before``."""
        top = float("inf")
        right_edge, left_edge = [], []
        upper = top
        while True:  # (token at the border, from when it stands, until when it stands)
            made = self.made.get(a)
            right_edge.append((a, made[2] if made else -1, upper))
            if not made:
                break
            upper, a = made[2], made[1]
        upper = top
        while True:
            made = self.made.get(b)
            left_edge.append((b, made[2] if made else -1, upper))
            if not made:
                break
            upper, b = made[2], made[0]
        rank = self.rank
        for x, x_from, x_until in right_edge:
            for y, y_from, y_until in left_edge:
                r = rank.get((x, y))
                # of two equal merges the left one comes first: hence < on the left, <= on the right
                if r is not None and r < before and x_from < r < x_until and y_from < r <= y_until:
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= 2 * self.remembered:
            self.pairs.clear()
        known = self.pairs[a << 24 | b] = self._uncrossed(a, b, 1 << 60)
        return known

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one pretoken."""
        one = self.whole.get(data)
        if one is not None:
            return [one]
        n, pairs = len(data), self.pairs
        last = [-1] * (n + 1)  # the token that ends each prefix
        size_of, found = self.size_of, -1
        for end, token in self.automaton.iter(data.decode("latin-1")):
            if end == found:  # the longest compatible suffix of this prefix is known
                continue
            start = end + 1 - size_of[token]
            if start:
                ok = pairs.get(last[start] << 24 | token)
                if not (self.compatible(last[start], token) if ok is None else ok):
                    continue
            last[end + 1] = token
            found = end
        out = []
        while n:
            out.append(last[n])
            n -= size_of[last[n]]
        return out[::-1]

    def compatible_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs, by a table of the pairs met last."""
        key = a << 24 | b
        slot = (key.astype(np.uint64) * BASE >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out, new = self.pair_ok[slot], self.pair_key[slot] != key
        if new.any():
            todo, at = np.unique(key[new], return_inverse=True)
            ok = np.array([self._uncrossed(k >> 24, k & 0xFFFFFF, 1 << 60) for k in todo.tolist()], bool)
            out[new] = ok[at]
            slot = (todo.astype(np.uint64) * BASE >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
            self.pair_key[slot], self.pair_ok[slot] = todo, ok  # of two in one slot the same one stays in both
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of many pretokens: the automaton runs over all of them in one go, and the prefixes of one
        length of all of them are settled together."""
        out: list[bytes] = []
        for lo in range(0, len(words), WORDS_AT_ONCE):
            part = words[lo : lo + WORDS_AT_ONCE]
            size = np.array([len(w) for w in part], np.int64)
            begin = np.cumsum(size + 1) - size - 1
            joined = BETWEEN.join([w.decode("latin-1") for w in part])
            found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
            owner = np.repeat(np.arange(len(part)), size + 1)
            end, token = found[:, 0] + 1, found[:, 1]
            prefix = end - begin[owner[found[:, 0]]]
            start = end - self.size_of_token[token]
            order = np.argsort(prefix.astype(np.uint16), kind="stable")
            end, token, start, prefix = end[order], token[order], start[order], prefix[order]
            last = np.full(len(joined) + 1, -1, np.int64)  # the token that ends each prefix; none at a word's begin
            edges = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])) if len(prefix) else []
            for s, e in zip(edges, np.append(edges[1:], len(prefix)), strict=True):
                before, now = last[start[s:e]], token[s:e]
                ok = before < 0
                inner = np.flatnonzero(~ok)
                ok[inner] = self.compatible_many(before[inner], now[inner])
                hit = np.flatnonzero(ok)
                if len(hit):  # of those that end one prefix the longest comes first
                    at = end[s:e][hit]
                    first = np.append(True, at[1:] != at[:-1])
                    last[at[first]] = now[hit[first]]
            at, who, ids, back = begin + size, np.arange(len(part)), [], []
            while len(who):
                t = last[at]
                ids.append((who, t))
                at = at - self.size_of_token[t]
                left = at > begin[who]
                at, who = at[left], who[left]
            n = np.bincount(np.concatenate([w for w, _ in ids]), minlength=len(part))
            upto = np.cumsum(n)
            flat = np.empty(upto[-1], np.uint32)
            for k, (w, t) in enumerate(ids):
                flat[upto[w] - 1 - k] = t
            raw, cut = flat.tobytes(), np.concatenate([[0], 4 * upto]).tolist()
            out += [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        return out

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct texts without added tokens; most are pretokens or nearly so."""
        found = list(map(self.words.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        if not new:
            return found
        # the same letters as the pattern's, hence one pretoken; others are split
        split = {i: self.pretokens.findall(pieces[i]) for i in new if not pieces[i].isalpha() and not (pieces[i][0] == " " and pieces[i][1:].isalpha())}
        words = list({w for parts in split.values() for w in parts}.union([pieces[i] for i in new if i not in split]))
        known, older = self.words.get, self.older_words.get
        now = {w: known(w) or older(w) for w in words}
        short = [w for w, ids in now.items() if ids is None and len(w) < LONG]
        now.update(zip(short, self.encode_words([w.encode("utf-8") for w in short]), strict=True))
        now.update([(w, array("I", self.encode_bytes(w.encode("utf-8"))).tobytes()) for w, ids in now.items() if ids is None])
        for i in new:
            found[i] = b"".join([now[w] for w in split[i]]) if i in split else now[pieces[i]]
        for lo in range(0, len(words), self.remembered):
            if len(self.words) >= self.remembered:
                self.older_words, self.words = self.words, {}
            self.words.update([(w, now[w]) for w in words[lo : lo + self.remembered - len(self.words)] if len(w) < LONG])
        return found

    def _plain(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of adjacent texts without added tokens, index of each text's first id and the total).

        ``data``: their bytes; ``starts``: of each text, ascending. Texts are cut where a pretoken is
        sure to begin; each distinct piece is encoded once."""
        cut = pretoken_starts(data)
        cut[starts[starts < len(data)]] = True
        begin = np.flatnonzero(cut)
        offsets = np.append(begin, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        found = self.pieces(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = pieces.indices.to_numpy(zero_copy_only=False)
        size = np.array([len(f) for f in found], np.int64) >> 2
        every = np.frombuffer(b"".join(found), np.uint32)
        own = size[which]
        upto = np.concatenate([[0], np.cumsum(own)])
        return every[ranges((np.cumsum(size) - size)[which], own)], upto[np.searchsorted(begin, np.append(starts, len(data)))]

    def encode_many(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for any adjacent texts; those with added tokens are encoded part by part."""
        if self.split is None or not any(t.encode() in data.tobytes() for t in self.added):
            return self._plain(data, starts)
        out, n = [], [0]
        for s, e in zip(starts, np.append(starts[1:], len(data)), strict=True):
            out.append(np.frombuffer(self.encode(data[s:e].tobytes().decode("utf-8", "replace")), np.uint32))
            n.append(n[-1] + len(out[-1]))
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.array(n, np.int64)

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        parts = self.split.split(text) if self.split is not None else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                data = np.frombuffer(part.encode("utf-8"), np.uint8)
                for lo, hi in stretches(data):
                    out.append(self._plain(data[lo:hi], np.zeros(1, np.int64))[0].tobytes())
        return b"".join(out)

    def decode_many(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids one after the other, place of each id's first byte and the total)."""
        size = self.length_of[ids]
        return self.all_bytes[ranges(self.start_of[ids], size)], np.concatenate([[0], np.cumsum(size)])

    def decode(self, ids: bytes) -> str:
        return self.decode_many(np.frombuffer(ids, np.uint32))[0].tobytes().decode("utf-8", "replace")


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + size[0] - 1, first[1] .. and so on, as one array."""
    upto = np.cumsum(size)
    return np.repeat(first - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


BLANK, VISIBLE, WORD, SIGN, LAST, BEFORE = (np.zeros(256, bool) for _ in range(6))
BLANK[[9, 10, 13, 32]] = True
VISIBLE[0x21:0x7F] = VISIBLE[0x80:] = True
WORD[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
SIGN[[c for c in range(0x21, 0x7F) if not WORD[c] and c != ord("'")]] = True
# the last two bytes of white space beyond ASCII are a byte of LAST after one of BEFORE
for _c in range(0x80, 0x3001):
    if chr(_c).isspace() or regex.match(r"\s", chr(_c)):
        LAST[chr(_c).encode()[-1]] = BEFORE[chr(_c).encode()[-2]] = True


def pretoken_starts(data: np.ndarray) -> np.ndarray:
    """Where in UTF-8 bytes a pretoken is sure to begin: at a blank after a visible character, and where
    ASCII letters or digits (or letters of the bytes C3 xx) end at a sign other than the apostrophe. No
    alternative of the pattern goes on over such a place, none looks back, and what looks ahead has
    ended before. Places that aren't found cost time only."""
    out = np.zeros(len(data), bool)
    out[1:] = BLANK[data[1:]] & VISIBLE[data[:-1]]
    out[2:] &= ~(LAST[data[1:-1]] & BEFORE[data[:-2]])
    sign = SIGN[data[1:]]
    out[1:] |= sign & WORD[data[:-1]]
    letter = (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
    out[2:] |= sign[1:] & letter
    return out


#: Bytes of adjacent texts that are encoded at once; bounds memory, not a text.
AT_ONCE = 1 << 23


def stretches(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts a long text at starts of pretokens into stretches of about AT_ONCE bytes."""
    lo = 0
    while len(data) - lo > 2 * AT_ONCE:
        cut = np.flatnonzero(pretoken_starts(data[lo + AT_ONCE - 2 : lo + 2 * AT_ONCE])[2:])
        if not len(cut):
            break
        yield lo, lo + AT_ONCE + int(cut[0])
        lo += AT_ONCE + int(cut[0])
    yield lo, len(data)


_coder: tuple[int, Coder] | None = None


def _coded(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    global _coder
    if _coder is None or _coder[0] != vocabulary.value["key"]:
        _coder = (vocabulary.value["key"], Coder(vocabulary.value))
    coder = _coder[1]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for batch in batches:
        raw, starts, ends = utf8(batch.column(1))
        for lo, hi in spans(starts, ends, AT_ONCE):
            if ends[hi - 1] - starts[lo] > 2 * AT_ONCE:  # one long text
                parts = [np.frombuffer(coder.encode(raw[starts[lo] : ends[lo]].tobytes().decode("utf-8", "replace")), np.uint32)]
            else:
                size = ends[lo:hi] - starts[lo:hi]
                data = raw[starts[lo] : ends[hi - 1]] if size.sum() == ends[hi - 1] - starts[lo] else raw[ranges(starts[lo:hi], size)]
                ids, at = coder.encode_many(data, np.cumsum(size) - size)
                parts = [ids[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
            yield coded_rows(batch.column(0).slice(lo, hi - lo), parts, coder)


def coded_rows(column: pa.Array, parts: list[np.ndarray], coder: Coder) -> pa.RecordBatch:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    back = []
    for ids in parts:
        h = hashlib.sha256()
        text = codecs.getincrementaldecoder("utf-8")("replace")
        for lo in range(0, len(ids), AT_ONCE):
            h.update(text.decode(coder.decode_many(ids[lo : lo + AT_ONCE])[0].tobytes()).encode("utf-8"))
        h.update(text.decode(b"", True).encode("utf-8"))
        back.append(h.hexdigest())
    columns = [column, pa.array([len(ids) for ids in parts], pa.int64()), pa.array([sha(ids) for ids in parts], pa.string()), pa.array(back, pa.string()), pa.array([ids.tobytes() for ids in parts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])


def encoded(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, n_tokens, ids_sha256, decoded_sha256, ids).

    ids: the ids of the whole text as little-endian unsigned 32-bit integers; decoded_sha256: of the
    text that those ids decode to. A null text counts as empty and has no ids. Strings of added tokens
    in a text become their ids. Repeated rows give repeated rows; other columns are ignored.
    A map over partitions without any shuffle; each row depends on itself only.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(vocabulary_path) | {"key": vocabulary_path})
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(lambda it: _coded(it, shared), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
    return out.withColumnRenamed("id", id_col)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokens(spark: SparkSession, docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    return encoded(docs, vocabulary_path or default_vocabulary())
