"""Many terms in many texts: one automaton with failure links over all terms, one pass over each text.

Terms are a table. The automaton is built once on the driver and broadcast, behind a check of its size;
terms beyond that size form several automata, each with a pass of its own. Texts stream through in Arrow
batches. A match of a group of terms is what the alternation of its terms would find, longest first, with
the edges of whole words: the leftmost, of those the longest, none overlapping another of its group.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of one automaton that is broadcast, and terms that reach the driver at once.
MOST_BYTES, MOST_TERMS = 48 << 20, 200_000
EDGES = ("word", "alnum", "any")

FOUND = "terms string, found string, start int, stop int"


def folded(text: str) -> str:
    """Lower case character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _of_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _of_name(c: str) -> bool:
    return c.isascii() and c.isalnum()


def whole(text: str, start: int, stop: int, edges: str) -> bool:
    """``word``: a word begins or ends at both edges of the match; ``alnum``: no ASCII letter or digit
    stands beside it; ``any``: whatever stands beside it."""
    if edges == "any":
        return True
    before, after = text[start - 1] if start else "", text[stop] if stop < len(text) else ""
    if edges == "alnum":
        return not ((before and _of_name(before)) or (after and _of_name(after)))
    return (bool(before) and _of_word(before)) != _of_word(text[start]) and (bool(after) and _of_word(after)) != _of_word(text[stop - 1])


class Matcher:
    """Finds the terms of all groups in a text."""

    def __init__(self, terms: list[tuple[str, str]], edges: str = "word", ignore_case: bool = True):
        import ahocorasick

        if edges not in EDGES:
            raise ValueError(f"edges must be one of {EDGES}")
        self.edges, self.fold = edges, folded if ignore_case else str
        self.automaton = ahocorasick.Automaton()
        groups: dict[str, set[str]] = {}
        for group, term in terms:
            groups.setdefault(self.fold(term), set()).add(group)
        for term, its in groups.items():
            self.automaton.add_word(term, (len(term), sorted(its)))
        if groups:
            self.automaton.make_automaton()
        self.empty = not groups

    def all(self, text: str) -> list[tuple[int, int, str]]:
        """(start, stop, group) of every whole term, overlapping ones as well."""
        if self.empty or not text:
            return []
        out = []
        for end, (size, groups) in self.automaton.iter(self.fold(text)):
            start = end + 1 - size
            if whole(text, start, end + 1, self.edges):
                out += [(start, end + 1, g) for g in groups]
        return out

    def leftmost(self, text: str) -> list[tuple[int, int, str]]:
        """Of each group those that an alternation of its terms finds, one after the other."""
        last: dict[str, int] = {}
        out = []
        for start, stop, group in sorted(self.all(text), key=lambda m: (m[0], -m[1])):
            if start >= last.get(group, 0):
                last[group] = stop
                out.append((start, stop, group))
        return out


_matchers: dict[int, Matcher] = {}


def _matched(batches: Iterator[pa.RecordBatch], sent, key: int, overlapping: bool, once: bool) -> Iterator[pa.RecordBatch]:
    """(row, text) -> (row, terms, found, start, stop)."""
    if key not in _matchers:
        _matchers.clear()  # a worker holds one automaton at a time
        _matchers[key] = pickle.loads(sent.value)
    matcher = _matchers[key]
    find = matcher.all if overlapping else matcher.leftmost
    for batch in batches:
        rows, groups, found, starts, stops = [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            seen = set()
            for start, stop, group in find(text or ""):
                if once and not overlapping:
                    if (group, text[start:stop]) in seen:
                        continue
                    seen.add((group, text[start:stop]))
                rows.append(i)
                groups.append(group)
                found.append(text[start:stop])
                starts.append(start)
                stops.append(stop)
        row = batch.column(0).take(pa.array(rows, pa.int32()))
        yield pa.RecordBatch.from_arrays([row, pa.array(groups, pa.string()), pa.array(found, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=["row", "terms", "found", "start", "stop"])


def _parts(terms: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The terms in lists of bounded length; one list, unless there are more than MOST_TERMS."""
    number = max(1, -(-terms.count() // MOST_TERMS))
    for k in range(number):
        part = terms.where(F.pmod(F.xxhash64("term"), F.lit(number)) == k) if number > 1 else terms
        yield [(r["terms"], r["term"]) for r in part.select("terms", "term").toLocalIterator()]


def _automata(terms: list[tuple[str, str]], edges: str, ignore_case: bool, most_bytes: int) -> list[bytes]:
    made = pickle.dumps(Matcher(terms, edges, ignore_case))
    if len(made) <= most_bytes or len(terms) < 2:
        return [made]
    half = len(terms) // 2
    return _automata(terms[:half], edges, ignore_case, most_bytes) + _automata(terms[half:], edges, ignore_case, most_bytes)


def occurrences(rows: DataFrame, keys: list[str], terms: DataFrame, text: str = "text", edges: str = "word", ignore_case: bool = True, once: bool = False, trim: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(keys, terms, found, start, stop): each place of ``rows``' text where a group's term stands.

    terms: (terms, term), the group's name and one of its terms; empty and null terms are ignored, outer
    blanks are trimmed (``trim``), repeated ones count once. found: as the text spells it; start and stop: code
    points, stop exclusive. Case is ignored character by character (``ignore_case``). Null texts hold
    nothing. Rows whose keys repeat give each their own matches, unless the terms are so many that they
    form several automata. ``once``: of each group and spelling the first place in a text only.
    """
    spark = rows.sparkSession
    ship(spark)
    clean = terms.select(F.col("terms").cast("string").alias("terms"), (F.trim("term") if trim else F.col("term")).alias("term")).where("terms is not null and term <> ''").distinct()
    automata = [a for part in _parts(clean) for a in _automata(part, edges, ignore_case, most_bytes)]
    pair = rows.select(F.struct(*keys).alias("row"), F.col(text).cast("string").alias("text"))
    kind = pair.schema["row"].dataType.simpleString()
    several = len(automata) > 1
    out = None
    for made in automata:
        sent, key = spark.sparkContext.broadcast(made), hash(made)
        part = pair.mapInArrow(lambda it, s=sent, k=key: _matched(it, s, k, several, once), f"row {kind}, {FOUND}")
        out = part if out is None else out.unionByName(part)
    out = out.select("row.*", "terms", "found", "start", "stop")
    if not several:
        return out
    out = settled(out, keys)
    return out.groupBy(*keys, "terms", "found").agg(F.min(F.struct("start", "stop")).alias("p")).select(*keys, "terms", "found", "p.*") if once else out


def settled(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping matches of several automata -> the leftmost and longest of each row and group."""
    place = F.struct("start", (-F.col("stop")).alias("back"), "found")
    held = matches.groupBy(*keys, "terms").agg(F.array_sort(F.array_distinct(F.collect_list(place))).alias("m"))
    one = lambda m: F.struct(m["start"].alias("start"), (-m["back"]).alias("stop"), m["found"].alias("found"))
    none = F.array().cast("array<struct<start:int,stop:int,found:string>>")

    def add(kept, m):
        last = F.coalesce(F.get(kept, F.size(kept) - 1)["stop"], F.lit(0))
        return F.when(m["start"] >= last, F.concat(kept, F.array(one(m)))).otherwise(kept)

    kept = held.withColumn("m", F.aggregate("m", none, add)).select(*keys, "terms", F.explode("m").alias("m"))
    return kept.select(*keys, "terms", "m.found", "m.start", "m.stop")
