"""Text functions: Column in, Column out, all inside Catalyst.

Patterns use only what Java's and RE2's regular expressions share; white space is spelt out because
Java's ``\\s`` is ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token pattern, folded signs, and title rules in their order.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9\-.]*"
WHITE = r"[ \t\n\r\f\x0B\x{00A0}\x{2009}\x{202F}]+"
CURLY, STRAIGHT = "‘’“”–—", "''\"\"--"
DASHES = "‐‑‒–—−"
TITLE_RULES = (
    ("introduction", "intro"),
    ("background", "intro"),
    ("statistical", "methods"),
    ("method", "methods"),
    ("material", "methods"),
    ("patients and", "methods"),
    ("study design", "methods"),
    ("data collection", "methods"),
    ("result", "results"),
    ("finding", "results"),
    ("discussion", "discussion"),
    ("conclusion", "discussion"),
    ("limitation", "discussion"),
)
EXCLUDED_TITLES = ("acknowledg", "funding", "conflict", "competing interest", "author contribution", "availability", "abbreviation", "supplementary", "ethic", "consent", "reference", "declaration")
BOILERPLATE_TITLES = ("acknowledg", "funding", "ethic", "competing interest", "conflict of interest", "data availability", "abbreviation", "author contribution", "supplementary")
REFUSALS = ("not found in this corpus", "not found in the corpus", "no information", "not covered in this corpus", "not present in this corpus", "could not find", "no articles in this corpus", "does not appear in this corpus")


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; a dot or hyphen at a token's end stays. Null gives none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITE, " "))


def trimmed(text: Column) -> Column:
    """Without spaces of any width at its ends; tabs and line breaks stay."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", "")


def fold_quotes(text: Column) -> Column:
    """For tolerant search: straight quotes and dashes, single spaces."""
    return collapse(F.translate(text, CURLY, STRAIGHT))


def normalize(text: Column) -> Column:
    """For checks: lower case, one kind of dash, single spaces."""
    return collapse(F.translate(F.lower(text), DASHES, "-" * len(DASHES)))


def digest(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 12)


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(parts))


def classify_section(section: Column, title: Column) -> Column:
    """abstract, the stratum of the first rule that fits, body_other, or null for excluded titles."""
    out = F.when(section == "abstract", F.lit("abstract")).when(title.isNull(), F.lit("body_other")).when(has_any(title, EXCLUDED_TITLES), F.lit(None).cast("string"))
    for part, stratum in TITLE_RULES:
        out = out.when(F.contains(F.lower(title), F.lit(part)), F.lit(stratum))
    return out.otherwise(F.lit("body_other"))


def is_boilerplate(title: Column) -> Column:
    return F.coalesce(has_any(title, BOILERPLATE_TITLES), F.lit(False))


def overlap_share(query: Column, text: Column, if_empty: float = 0.0) -> Column:
    """Share of the query's distinct tokens that the text holds; ``if_empty`` without tokens."""
    return held_share(F.array_distinct(tokens(query)), tokens(text), if_empty)


def held_share(q: Column, held: Column, if_empty: float = 0.0) -> Column:
    """``overlap_share`` of distinct tokens that are there already."""
    return F.when(F.size(q) == 0, F.lit(if_empty)).otherwise(F.size(F.array_intersect(q, held)) / F.size(q))


def numbers_in(text: Column) -> Column:
    """Distinct numbers, sorted, after thousands separators between digits are removed."""
    plain = F.regexp_replace(text, r"(?<=\d)[, \x{00A0}\x{2009}\x{202F}](?=\d)", "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?<![A-Za-z0-9.])\d+(?:\.\d+)?"), F.lit(0))))


def notation_kind(form: Column) -> Column:
    return F.when(F.startswith(form, F.lit("rs")), "rsid").when(F.substring(form, 1, 2).isin("c.", "g.", "m."), "cdna").when(F.startswith(form, F.lit("p.")), "protein").otherwise("legacy")


def notation_axis(a: Column, b: Column) -> Column:
    """The two kinds in order, legacy names counted with cdna."""
    kind = lambda x: F.when(notation_kind(x) == "legacy", F.lit("cdna")).otherwise(notation_kind(x))
    return F.array_join(F.array_sort(F.array(kind(a), kind(b))), "<->")


def refuses(text: Column) -> Column:
    return has_any(F.coalesce(text, F.lit("")), REFUSALS)


def expand_to_line(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """(start, end) of the whole lines that hold the half-open range."""
    before = F.substring(text, F.lit(1), start)
    last = F.length(before) - F.coalesce(F.nullif(F.locate("\n", F.reverse(before)), F.lit(0)), F.length(before) + 1) + 1
    after = F.locate("\n", F.substring(text, end + 1, F.length(text)))
    return last, F.when(after > 0, end + after - 1).otherwise(F.length(text))


def quoted_blocks(note: Column) -> Column:
    """Quoted stretches of 15 characters at least, longest first."""
    quoted = F.filter(F.filter(F.split(note, "'"), lambda x, i: i % 2 == 1), lambda x: F.length(x) >= 15)
    longest = F.transform(F.array_sort(F.transform(quoted, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])
    return longest


def quote_candidates(note: Column) -> Column:
    """What to search for: each quoted stretch of 15 characters at least and then its sentences of that
    length, which may still stand where the whole doesn't; in the note's order, distinct."""
    blocks = F.filter(F.filter(F.split(note, "'"), lambda x, i: i % 2 == 1), lambda x: F.length(x) >= 15)
    return F.array_distinct(F.flatten(F.transform(blocks, lambda b: F.concat(F.array(b), F.filter(F.split(b, r"(?<=[.;])" + WHITE), lambda x: F.length(x) >= 15)))))


def parse_verdict(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(text), r"[*`]", ""))
    return F.nullif(F.regexp_extract(clean, r"^(valid|wrong|unsure)($|[ (,])", 1), F.lit(""))


def pub_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(19|20)[0-9][0-9]", 0), F.lit("")).cast("int")
