"""Article XML to paragraphs. Mixed content needs a tree, so this one step is Python in Arrow batches;
offsets and all that follows are native."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..operators import labels, spans

SECTIONS = ("abstract", "body")
MARK = "\x00"
#: Fixed value: what may stand between citations.
CONNECTOR = re.compile(r"[,;\-‐‑‒–—−\s\[\]()]*")
FIELDS = "section string, ord int, title string, text string, marked string"


def is_citation(e: ET.Element) -> bool:
    """A bibliographic reference, or a superscript that holds such references and connectors only."""
    cites = lambda x: x.tag == "xref" and x.get("ref-type") == "bibr"
    if e.tag == "sup":
        inside = [e.text, *(c.tail for c in e)]
        return len(e) > 0 and all(map(cites, e)) and all(CONNECTOR.fullmatch(t or "") for t in inside)
    return cites(e)


def marked_text(e: ET.Element) -> str:
    """Text with one mark in place of each citation."""
    out = [e.text or ""]
    for child in e:
        out += [MARK if is_citation(child) else marked_text(child), child.tail or ""]
    return "".join(out)


def article(xml: str | bytes | None) -> list[tuple[str, int, str | None, str, str]]:
    """(section, ord, title, text, marked) of an article; none if it is missing or malformed.

    The first abstract and the first body count. Each p at any depth is a paragraph, with all text
    inside it; a section without p is one paragraph if it has text. The title is that of the nearest
    enclosing sec whose own title isn't blank.
    """
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    rows = []
    for section in SECTIONS:
        node = root.find(f".//{section}")
        if node is None:
            continue
        titles: dict[ET.Element, str | None] = {}

        def descend(e: ET.Element, title: str | None) -> None:
            if e.tag == "sec" and (own := e.find("title")) is not None:
                title = " ".join("".join(own.itertext()).split()) or title
            titles[e] = title
            for child in e:
                descend(child, title)

        above = None  # a section may itself stand in a sec
        for sec in root.iter("sec"):
            if node in sec.iter() and (own := sec.find("title")) is not None:
                above = " ".join("".join(own.itertext()).split()) or above
        descend(node, above)
        found = node.findall(".//p")
        if found:
            rows += [(section, i, titles[p], "".join(p.itertext()), marked_text(p)) for i, p in enumerate(found)]
        elif whole := "".join(node.itertext()):
            rows.append((section, 0, None, whole, marked_text(node)))
    return rows


def paragraphs(articles: DataFrame, id_col: str = "pmcid", xml_col: str = "xml") -> DataFrame:
    """(pmcid, section, ord, title, text, clean, char_start, char_end): clean is without citations."""
    ship(articles.sparkSession)
    kind = articles.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 128):
                part = batch.slice(lo, 128)
                ids, rows = [], []
                for i, x in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    found = article(x.as_py())
                    rows += found
                    ids += [i] * len(found)
                cols = list(zip(*rows, strict=True)) or [()] * 5
                types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, part.column(0).type), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["pmcid", "section", "ord", "title", "text", "marked"])

    out = articles.select(F.col(id_col).alias("pmcid"), F.col(xml_col).cast("string").alias("xml")).mapInArrow(work, f"pmcid {kind}, {FIELDS}")
    return spans.with_offsets(out.withColumn("clean", labels.without_citations(F.col("marked"), r"\x00")).drop("marked"))
