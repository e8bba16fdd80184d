"""Media columns: interleaved document sequences.

A page becomes an ordered sequence of text and media references, with captions; references name their
payload by digest, and a join on the digest puts what is known of the payload into its place. Payloads
are kept as 8-bit samples of a grey image (the portable grey map: a short header, then the bytes as
they are), 64 samples a row, so that storing them loses nothing.

A reference may name a part of an image by a media fragment, ``digest:...#xywh=0,row,64,rows``. So a
document becomes a sequence of its own: its paragraphs in order, each part of its image after the
paragraph that the part's last sample belongs to, and the whole image after its middle paragraph.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._store import written

ROW_BYTES = 64
SCHEME = "digest:"
#: Rows of an image that one part of it holds.
PART_ROWS = 64
ELEMENT = "struct<position int, kind string, text string, ref string, caption string, medium string>"
ELEMENT_ARROW = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string()), ("medium", pa.string())]))
#: Elements that end a stretch of text, and those whose content is none.
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td th thead title tr ul video audio".split())
SILENT = frozenset("script style template noscript".split())
MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "object"}


class Sequence(HTMLParser):
    """Collects (kind, text, ref, caption, medium) in reading order; malformed HTML is read as it stands:
    a caption that isn't closed ends with its figure."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self.text: list[str] = []
        self.silent = 0
        self.figure: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        joined = " ".join("".join(self.text).split())
        self.text.clear()
        if joined:
            self.elements.append(["text", joined, None, None, None])

    def close_caption(self) -> None:
        """Gives the caption to the media of its figure."""
        if self.caption is None:
            return
        said = " ".join("".join(self.caption).split())
        self.caption = None
        for e in self.elements[self.figure[-1] if self.figure else 0 :]:
            if e[0] == "media" and said:
                e[3] = said

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        if self.caption is None and (tag in BLOCKS or tag in MEDIA):
            self.flush()
        if tag == "figure":
            self.close_caption()
            self.figure.append(len(self.elements))
        elif tag == "figcaption":
            self.close_caption()
            self.caption = []
        elif tag in MEDIA:
            given = dict(attrs)
            if given.get("src"):
                self.elements.append(["media", None, given["src"], (given.get("alt") or "").strip() or None, MEDIA[tag]])

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT and self.silent:
            self.silent -= 1
        if tag == "figcaption":
            self.close_caption()
        elif tag == "figure":
            self.close_caption()
            self.flush()
            if self.figure:
                self.figure.pop()
        elif tag in BLOCKS and self.caption is None:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)

    def finish(self) -> list[dict]:
        self.close()
        self.close_caption()
        self.flush()
        return [{"position": i, "kind": k, "text": t, "ref": r, "caption": c, "medium": m} for i, (k, t, r, c, m) in enumerate(self.elements)]


def parse(page: str | None) -> list[dict]:
    s = Sequence()
    s.feed(page or "")
    return s.finish()


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: (id, elements), elements ordered by position from 0. A null or
    empty page has none. Media without src don't count. Other columns are ignored. No shuffle."""
    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, elements array<{ELEMENT}>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([parse(v.as_py()) for v in part.column(1)], ELEMENT_ARROW)], names=["id", "elements"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("h")).mapInArrow(work, schema).withColumnRenamed("id", id_col)


def payload(data: bytes) -> bytes:
    return data + bytes(-len(data) % ROW_BYTES or (0 if data else ROW_BYTES))


def image(data: bytes) -> bytes:
    """A payload, whose length is a multiple of ROW_BYTES, as a portable grey map."""
    return b"P5\n%d %d\n255\n" % (ROW_BYTES, len(data) // ROW_BYTES) + data


def samples(stored: bytes) -> bytes:
    """The payload of a portable grey map."""
    kind, size, depth, data = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(data) != width * height:
        raise ValueError("not a grey map of 8-bit samples")
    return data


def feature(data: bytes) -> str:
    """Shares of the samples' 16 intensity bands in thousandths, and the mean of 4 quarters."""
    x = np.frombuffer(data, np.uint8)
    bands = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    quarters = [int(q.mean() * 10) for q in np.array_split(x, 4)]
    return "-".join(map(str, [*bands.tolist(), *quarters]))


def parts_of(rows: int) -> list[tuple[int, int]]:
    """(first row, rows) of an image's parts; an image that is one part has no parts of its own."""
    return [(r, min(PART_ROWS, rows - r)) for r in range(0, rows, PART_ROWS)] if rows > PART_ROWS else []


def page(text: str, digest: str, rows: int, caption: str | None) -> str:
    """A document as a page: paragraphs, the parts of its image, and the whole image."""
    lines = text.split("\n")
    parts, k, upto, out = parts_of(rows), 0, 0, []
    figure = lambda fragment, said: f'<figure><img src="{SCHEME}{digest}{fragment}"><figcaption>{html.escape(said)}</figcaption></figure>'
    for i, line in enumerate(lines):
        out.append(f"<p>{html.escape(line)}</p>")
        upto += len(line.encode("utf-8")) + 1
        last = i == len(lines) - 1
        while k < len(parts) and (last or (parts[k][0] + parts[k][1]) * ROW_BYTES <= upto):
            out.append(figure(f"#xywh=0,{parts[k][0]},{ROW_BYTES},{parts[k][1]}", f"{caption or ''} {k + 1}/{len(parts)}"))
            k += 1
        if i == (len(lines) - 1) // 2:
            out.append(figure("", caption or ""))
    return "".join(out)


def stored(docs: DataFrame, id_col: str, text_col: str, caption_col: str) -> DataFrame:
    """Payloads as a written table: (row, id, n_bytes, caption, digest, media); row is a number of the
    row's own."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                n, digest, media = [], [], []
                for text in part.column(2):
                    raw = (text.as_py() or "").encode("utf-8")
                    n.append(len(raw))
                    raw = payload(raw)
                    digest.append(hashlib.sha256(raw).hexdigest())
                    media.append(image(raw))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), part.column(3), pa.array(digest, pa.string()), pa.array(media, pa.binary())], names=["row", "id", "n_bytes", "caption", "digest", "media"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(caption_col).cast("string").alias("caption"))
    return written(rows.mapInArrow(work, f"row long, id {kind}, n_bytes long, caption string, digest string, media binary"), "media")


FACTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(media: DataFrame) -> DataFrame:
    """(digest, media) -> (digest, first_row, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature), all computed from the stored bytes: a row for the whole image, with
    first_row -1, and one for each of its parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["digest", "first_row", *(c.split(" ")[0] for c in FACTS.split(", "))]
        facts = lambda data, raw: (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(data))
        for batch in batches:
            rows = []
            for digest, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = value.as_py()
                data = samples(raw)
                rows.append((digest, -1, *facts(data, raw)))
                for first, n in parts_of(len(data) // ROW_BYTES):
                    part = data[first * ROW_BYTES : (first + n) * ROW_BYTES]
                    rows.append((digest, first, *facts(part, image(part))))
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return media.select("digest", "media").mapInArrow(work, f"digest string, first_row long, {FACTS}")


def pages_of(media: DataFrame) -> DataFrame:
    """(row, html): the page of each stored document, its text read back from the stored bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part, out = batch.slice(lo, 256), []
                for n, caption, digest, value in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), part.column(4), strict=True):
                    data = samples(value.as_py())
                    out.append(page(data[:n].decode("utf-8", "replace"), digest, len(data) // ROW_BYTES, caption))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["row", "html"])

    return media.select("row", "n_bytes", "caption", "digest", "media").mapInArrow(work, "row long, html string")


def resolved(sequence: DataFrame, payloads: DataFrame, id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Elements of ``sequence`` with what ``payloads`` says of those that are media:
    (id, keep..., position, kind, text, caption, medium, digest, first_row, n_rows, payload columns).

    ``payloads`` has one row a digest or, with a column first_row, one for each part too (-1: the whole).
    References that name no known digest have nulls there. Text elements are kept, so positions stay
    without gaps. A digest that a third of all rows share is one row of ``payloads`` and a skewed,
    splittable join."""
    e = sequence.select(id_col, *keep, F.explode("elements").alias("e"))
    ref = F.col("e.ref")
    known = F.startswith(ref, F.lit(SCHEME))
    part = lambda k: F.nullif(F.regexp_extract(ref, r"#xywh=[0-9]+,([0-9]+),[0-9]+,([0-9]+)$", k), F.lit("")).cast("long")
    digest = F.substring_index(F.substring(ref, len(SCHEME) + 1, 1_000), "#", 1)
    e = e.select(id_col, *keep, "e.position", "e.kind", "e.text", "e.caption", "e.medium", F.when(known, digest).alias("digest"), F.when(known, F.coalesce(part(1), F.lit(-1).cast("long"))).alias("first_row"), part(2).alias("n_rows"))
    return e.join(payloads, ["digest", "first_row"] if "first_row" in payloads.columns else "digest", "left")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", caption_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: (id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, position, caption, figures).

    Each whole text, as UTF-8 and padded by bytes 0 to a positive multiple of 64, is stored as an
    image. Its page, made from the stored bytes, is parsed into paragraphs and references to the whole
    image and to its parts of PART_ROWS rows; the digest join finds what was computed from the stored
    bytes. position and caption are those of the whole image; figures tells of each part, in reading
    order, (position, caption, first_row, n_rows, tail_crc32). An image of one part has none.

    Null texts count as empty (64 bytes 0, position 0); a null caption is none. Blank lines are no
    elements. Equal texts give equal values; repeated rows give a row each. Texts cross no shuffle:
    they are written once and read back; joins move digests and a few numbers.
    """
    ship(docs.sparkSession)
    media = stored(docs, id_col, text_col, caption_col)
    facts = described(media)
    names = [c.split(" ")[0] for c in FACTS.split(", ")]
    once = facts.groupBy("digest", "first_row").agg(*[F.first(c).alias(c) for c in names])
    found = resolved(sequences(pages_of(media), "row"), once, "row").where("kind = 'media'")
    whole = F.col("first_row") < 0
    figure = F.struct("position", "caption", "first_row", "n_rows", "tail_crc32")
    per = found.groupBy("row").agg(*[F.max(F.when(whole, F.col(c))).alias(c) for c in [*names, "position", "caption"]], F.array_sort(F.collect_list(F.when(~whole, figure))).alias("figures"))
    out = media.select("row", F.col("id").alias("_id"), "n_bytes").join(per, "row")
    return out.select(F.col("_id").alias(id_col), "n_bytes", *names, "position", "caption", "figures")
