"""Paragraphs, source spans and the joins between them. Spans are half-open code-point ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import forms

KEYS = ("pmcid", "section")
#: Characters of a bin in which spans meet.
WIDTH = 2048


def with_offsets(paragraphs: DataFrame) -> DataFrame:
    """Adds char_start and char_end to (pmcid, section, ord, text): paragraphs of a section follow each
    other with one line break between; an empty paragraph has length 0 but moves the next by one."""
    before = Window.partitionBy(*KEYS).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return paragraphs.withColumn("char_start", start).withColumn("char_end", (F.col("char_start") + F.length("text")).cast("int"))


def lines(sections: DataFrame) -> DataFrame:
    """The lines of whole sections (pmcid, section, text, ..) as paragraphs with ord and offsets, as
    ``with_offsets`` gives them; a section is one row, so that nothing travels."""
    text = F.split("text", "\n")
    ends = F.aggregate(text, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1) + 1, F.lit(0)) + F.length(x))))
    out = sections.select(*[c for c in sections.columns if c != "text"], F.posexplode(F.arrays_zip(text.alias("text"), ends.alias("char_end"))).alias("ord", "_l"))
    return out.select("*", "_l.text", (F.col("_l.char_end") - F.length("_l.text")).alias("char_start"), "_l.char_end").drop("_l")


def section_text(paragraphs: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("ord", "text")))
    return paragraphs.groupBy(*KEYS).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def dereference(spans: DataFrame, sections: DataFrame, documents: DataFrame) -> DataFrame:
    """spans with span_text and error: missing_file, no_such_section_or_unparseable, out_of_range or null."""
    # what is known of an article meets the sections that are asked for, so that spans are dealt once and a
    # text never travels with them; a struct holds a null section, which is none but whose article may be known
    at = F.struct("section").alias("_at")
    s = sections.where("section is not null").select("pmcid", at, F.col("text").alias("_text"), F.length("text").alias("_size"))
    d = documents.select("pmcid").distinct().withColumn("_known", F.lit(True))
    asked = spans.select("pmcid", at).distinct().join(d, "pmcid", "left").join(s, ["pmcid", "_at"], "left")
    out = spans.withColumn("_at", F.struct("section")).join(asked, ["pmcid", "_at"], "left")
    start, end = F.col("char_start"), F.col("char_end")
    error = F.when(F.col("_known").isNull(), "missing_file").when(F.col("_text").isNull(), "no_such_section_or_unparseable").when(~((start >= 0) & (start < end) & (end <= F.col("_size"))), "out_of_range")
    return out.select(*spans.columns, error.alias("error"), F.when(error.isNull(), F.substring("_text", start + 1, end - start)).alias("span_text"))


def overlaps(a: str, b: str) -> Column:
    """Residual predicate of the interval join; touching ranges don't overlap."""
    return (F.col(f"{a}.char_start") < F.col(f"{b}.char_end")) & (F.col(f"{b}.char_start") < F.col(f"{a}.char_end"))


def overlap_join(a: DataFrame, b: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pairs of spans of one article and section that overlap, as aliases a and b.

    Spans are dealt into bins of ``width`` characters and meet within a bin, so a long section is joined in
    proportion to what overlaps, and its bins are spread over the tasks. A pair that shares several bins
    comes from the first of them only. An empty span overlaps what it lies within; null keys meet nothing.
    """
    first = lambda d: F.floor(F.col(f"{d}char_start") / width)
    dealt = lambda df: df.withColumn("_bin", F.explode(F.sequence(first(""), F.greatest(first(""), F.floor((F.col("char_end") - 1) / width)))))
    x, y = dealt(a).alias("a"), dealt(b).alias("b")
    same = (F.col("a.pmcid") == F.col("b.pmcid")) & (F.col("a.section") == F.col("b.section")) & (F.col("a._bin") == F.col("b._bin"))
    return x.join(y, same & overlaps("a", "b") & (F.col("a._bin") == F.greatest(first("a."), first("b.")))).drop("_bin")


def covering(spans: Column) -> Column:
    """Smallest start to largest end of an array of spans, in the first one's section."""
    return F.struct(F.get(spans, F.lit(0))["section"].alias("section"), F.array_min(F.transform(spans, lambda s: s["char_start"])).alias("char_start"), F.array_max(F.transform(spans, lambda s: s["char_end"])).alias("char_end"))


def verbatim(items: DataFrame, sections: DataFrame) -> DataFrame:
    """(item_id, pmcid, section, char_start, char_end) where items (item_id, item) first stand verbatim in
    sections (pmcid, section, text).

    A word inside an item, with a separator on either side, stands whole in every text that holds the
    item. Each item meets the texts that hold the rarest of its inner words; only ids travel until then,
    and the texts join once, for the scan. Items without an inner word (of one or two words) have no such
    key: one automaton of all of them reads each text once. A null section is one like any other.
    """
    words = lambda c: F.split(F.col(c), r"[^\p{L}\p{N}]+")
    inner = F.filter(F.slice(words("item"), 2, F.greatest(F.size(words("item")) - 2, F.lit(0))), lambda w: w != "")
    keyed = items.select("item_id", "item", F.array_distinct(inner).alias("inner"))
    wanted = keyed.select("item_id", F.explode("inner").alias("word"))
    held = sections.select("pmcid", "section", F.explode(F.array_distinct(words("text"))).alias("word")).join(wanted.select("word").distinct(), "word", "left_semi").repartition("word")
    df = held.groupBy("word").agg(F.count("*").alias("df"))
    key = wanted.join(df, "word", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "word"))["word"].alias("word"))
    near = held.join(key, "word").select("item_id", "pmcid", "section").join(keyed.select("item_id", "item"), "item_id")
    n, s = near.alias("n"), sections.alias("s")
    hit = n.join(s, (F.col("n.pmcid") == F.col("s.pmcid")) & F.col("n.section").eqNullSafe(F.col("s.section"))).select("item_id", "s.pmcid", "s.section", "item", "text")
    hit = hit.where(F.contains("text", F.col("item")))
    at = F.expr("instr(text, item)") - 1
    long = hit.select("item_id", *KEYS, at.cast("int").alias("char_start"), (at + F.length("item")).cast("int").alias("char_end"))
    kind = items.schema["item_id"].dataType
    short = keyed.where("size(inner) = 0 and item <> ''").select(F.col("item_id").cast("string").alias("terms"), F.col("item").alias("term"))
    found = forms.occurrences(sections, list(KEYS), short, edges="any", ignore_case=False, once=True, trim=False)
    return long.unionByName(found.select(F.col("terms").cast(kind).alias("item_id"), *KEYS, F.col("start").alias("char_start"), F.col("stop").alias("char_end")))
