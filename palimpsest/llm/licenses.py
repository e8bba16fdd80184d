"""License scan: phrases in place, and an exact set-similarity join of text blocks with templates.

Blocks are the lines of a text. A block matches a template if it holds at least ``threshold`` of the
template's distinct words (containment). The join is exact: words are ordered by how many texts of
the whole corpus hold them, rarest first; a matching block must hold one of the template's first
|T| - need + 1 words (prefix filter), at least ``need`` of the templates' words at all (length filter),
and what stands after the matched places in both must suffice (positional filter). What passes is
counted in full. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import written

#: Fixed values of the contract: phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices that licenses ask to be placed in works, in lower case words.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "mit-notice": "released under the mit license",
    "cc-notice": "this work is licensed under a creative commons attribution license",
    "cc0-notice": "to the extent possible under law the author has waived all copyright and related rights to this work",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "apache-grant": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "reserved": "all rights reserved no part of this publication may be reproduced without prior permission",
}
THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: All ASCII signs but digits, letters and the line break.
SIGNS = "".join(chr(c) for c in range(128) if chr(c) != "\n" and not chr(c).isalnum())


def cleaned(text: Column) -> Column:
    """The text in lower case, with a space for each sign; line breaks stay."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER + SIGNS, LOWER + " " * len(SIGNS))


def spaced(clean: Column) -> Column:
    """Words of a cleaned text, each after one space, with a space at the end; " " if there is none."""
    return F.regexp_replace(F.concat(F.lit(" "), clean, F.lit(" ")), "[ \n]+", " ")


def places(line: Column) -> Column:
    """Starts of every phrase in a spaced text, in words from 0, in order of phrases.

    The text is cut at the phrase, with a space of its own on either side of each word, and the words
    before each cut are summed up: time stays in proportion to the text. No phrase may begin as it ends.
    """
    wrapped = F.replace(line, F.lit(" "), F.lit("  "))
    wrapped = F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)
    count = lambda x: ((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) / 2).cast("int")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def of(phrase: str) -> Column:
        words = phrase.split(" ")
        if any(words[:k] == words[-k:] for k in range(1, len(words))):
            raise ValueError(f"{phrase!r} can overlap itself")
        parts = F.split(wrapped, f" {'  '.join(words)} ")
        step = lambda acc, x: F.struct((acc["at"] + count(x) + len(words)).alias("at"), F.concat(acc["found"], F.array(acc["at"] + count(x))).alias("found"))
        found = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step, lambda acc: acc["found"])
        return F.when(F.contains(line, F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))

    return F.concat(*[of(p) for p in PHRASES])


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(template, words): a few rows, fixed by the argument."""
    rows = ", ".join("('{}', array({}))".format(k.replace("'", "''"), ", ".join(f"'{w}'" for w in sorted(set(v.split())))) for k, v in templates.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, words)")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: (id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Base columns tell where the phrases stand; labels also holds the templates that some line matches,
    and score the best containment of any template by a line, as far as a line reaches the threshold
    (else 0). Null and empty texts have no words, empty labels and null places. Repeated rows give a
    row each. Other columns are ignored.

    The texts are read once, for a small written table: places of phrases, and the template words of
    lines that hold enough of them. Corpus frequencies come from it (pre-aggregated in each task; a few
    hundred rows at most leave it), and then the lines meet the templates. Templates are few and fixed,
    so they are broadcast; their number is checked.
    """
    spark = docs.sparkSession
    if sum(len(v.split()) for v in templates.values()) > 100_000:
        raise ValueError("templates are broadcast: 100,000 words at most")
    vocabulary = sorted({w for v in templates.values() for w in v.split()})
    known = F.array(*map(F.lit, vocabulary))
    smallest = int(min((-(-len(set(v.split())) * threshold // 1) for v in templates.values()), default=1))
    label = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(F.col("norm"), F.lit(f" {k} ")), F.lit(v)) for k, v in PHRASES.items()])))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), cleaned(F.col(text_col).cast("string")).alias("clean"))
    rows = rows.select("row", "id", spaced(F.col("clean")).alias("norm"), F.transform(F.split("clean", "\n"), lambda x: F.array_intersect(F.split(x, " "), known)).alias("lines"))
    small = rows.select("row", "id", (F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"), places(F.col("norm")).alias("p"), label.alias("b"), F.array_distinct(F.flatten("lines")).alias("seen"), F.filter("lines", lambda x: F.size(x) >= smallest).alias("blocks"))
    small = written(small, "lines")

    words = template_table(spark, templates).select("template", F.explode("words").alias("word"))
    counts = small.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    order = words.select("word").distinct().join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    ranked = words.join(order, "word").groupBy("template").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("t"))
    ranked = ranked.select("template", F.transform("t", lambda x: x["word"]).alias("t"), F.size("t").alias("size"), F.ceil(F.size("t") * F.lit(float(threshold)) - 1e-9).cast("int").alias("need"))
    prefix = ranked.select("template", "t", "size", "need", F.posexplode(F.slice(F.col("t"), F.lit(1), F.col("size") - F.col("need") + 1)).alias("at", "word"))
    by_rank = F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda x: x["word"])
    one = order.agg(by_rank.alias("o")).join(prefix.agg(F.collect_set("word").alias("first")))

    # of each line: its template words, rarest first, if one of them is in some template's prefix
    text = small.select("row", "id", "n_words", "p", "b", "blocks").join(F.broadcast(one))
    ordered = F.transform(F.filter("blocks", lambda x: F.arrays_overlap(x, F.col("first"))), lambda x: F.array_intersect(F.col("o"), x))
    hit = F.flatten(F.transform(ordered, lambda x: F.filter(F.transform(x, lambda w, i: F.struct(x.alias("words"), i.alias("pos"), w.alias("word"))), lambda h: F.array_contains(F.col("first"), h["word"]))))
    near = text.select("row", "id", "n_words", "p", "b", F.explode_outer(hit).alias("h")).select("row", "id", "n_words", "p", "b", "h.*").join(F.broadcast(prefix), "word", "left")
    rest = 1 + F.least(F.size("words") - F.col("pos") - 1, F.col("size") - F.col("at") - 1)
    held = F.when((F.size("words") >= F.col("need")) & (rest >= F.col("need")), F.size(F.array_intersect("words", "t")))
    near = near.withColumn("share", F.when(held >= F.col("need"), held / F.col("size")))
    # one row a text again; counts and lists are equal in all rows of a text
    out = near.groupBy("row", "id").agg(F.first("n_words").alias("n_words"), F.first("p").alias("p"), F.first("b").alias("b"), F.collect_set(F.when(F.col("share").isNotNull(), F.col("template"))).alias("t"), F.max("share").alias("score"))
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(F.col("id").alias(id_col), "n_words", F.size("p").cast("long").alias("n_base"), F.array_min("p").cast("long").alias("first_word"), F.array_max("p").cast("long").alias("last_word"), join(F.col("b")).alias("base_labels"), join(F.concat("b", "t")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``scan`` over documents: every line against every template, without filters."""
    words = lambda x: f"list_filter(regexp_split_to_array(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), '{SEPARATOR}'), lambda w: w <> '')"
    phrases = ", ".join(f"('{p}', '{v}')" for p, v in PHRASES.items())
    known = ", ".join(f"('{k}', list_distinct(string_split('{v}', ' ')))" for k, v in templates.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, {words("text")} AS w FROM documents),
phrase(p, label) AS (VALUES {phrases}),
known(template, t) AS (VALUES {known}),
place AS (
  SELECT r, label, unnest(list_filter(range(len(w)), lambda i: array_to_string(w[i + 1 : i + len(string_split(p, ' '))], ' ') = p)) AS i
  FROM d, phrase WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || p || ' ')),
base AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS b FROM place GROUP BY r),
line AS (SELECT r, {words("l")} AS w FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)),
hit AS (
  SELECT r, template, len(list_intersect(list_distinct(w), t)) / len(t)::DOUBLE AS share, len(list_intersect(list_distinct(w), t)) AS n, ceil(len(t) * {threshold} - 1e-9) AS need
  FROM line, known),
best AS (SELECT r, list(DISTINCT template) AS t, max(share) AS score FROM hit WHERE n >= need GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b, []), coalesce(t, [])))), ','), '') AS labels,
  coalesce(score, 0.0) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN best USING (r)"""
