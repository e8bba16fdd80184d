import hashlib
import zlib

from palimpsest.llm import interleaved, queries
from tests.conftest import SF

PAGE = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><p>one &amp; <b>two</b><img src="digest:00" alt=" a ">three</p>
<figure><img src=x.png><video src="digest:11"></video><figcaption>Fig <i>1</i></figcaption></figure>tail<img alt="none"><p>unclosed"""


def test_order_positions_and_captions():
    got = [(e["position"], e["kind"], e["text"] or e["ref"], e["caption"]) for e in interleaved.parse(PAGE)]
    want = [("text", "T", None), ("text", "one & two", None), ("media", "digest:00", "a"), ("text", "three", None), ("media", "x.png", "Fig 1"), ("media", "digest:11", "Fig 1"), ("text", "tail", None), ("text", "unclosed", None)]
    assert got == [(i, *w) for i, w in enumerate(want)]
    assert interleaved.parse(None) == interleaved.parse("") == []


def test_digests_resolve(spark):
    pages = spark.createDataFrame([(1, PAGE, "x"), (2, None, "x"), (3, '<img src="digest:00">', "x"), (3, '<img src="digest:00">', "x")], "page_id long, html string, elements string")
    payloads = spark.createDataFrame([("00", 7)], "digest string, size int")
    got = sorted((r["page_id"], r["position"], r["digest"], r["size"]) for r in interleaved.resolved(interleaved.sequences(pages), payloads, "page_id").where("kind = 'media'").collect())
    assert [g for g in got if g[0] == 1] == sorted([(1, 2, "00", 7), (1, 4, None, None), (1, 5, "11", None)], key=lambda g: g[1])
    assert [g for g in got if g[0] == 3] == [(3, 0, "00", 7)] * 2


def check(rows, got):
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    assert len(got) == len(rows)
    for r in got:
        raw = (texts[r["doc_id"]][0] or "").encode()
        data = raw + b"\0" * (64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        stored = b"P5\n64 %d\n255\n" % (len(data) // 64) + data
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == interleaved.feature(data)


def test_query_round_trip(spark):
    rows = [tuple(r) for r in queries.read(spark, SF, "documents").select("doc_id", "text").collect()]
    check(rows, queries.op4_interleaved_media(spark, SF).collect())


def test_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, "a" * 64), (4, "é\0\n" * 40_000), (5, "a" * 65), (5, "a" * 65), (6, "a" * 65)]
    df = spark.createDataFrame([(i, t, None if i == 1 else f"<s{i}>&", "x") for i, t in rows], "doc_id long, text string, source string, digest string")
    got = interleaved.media_columns(df).collect()
    check(rows, got)
    assert {r["doc_id"]: r["caption"] for r in got}[4] == "<s4>&" and {r["doc_id"]: r["caption"] for r in got}[1] is None
    assert interleaved.media_columns(df.limit(0)).collect() == []


def test_captions_end_with_their_figure():
    got = interleaved.parse('<figure><img src="a"><figcaption>cap</figure><p>text after</p><figure><audio src=b></audio><figcaption>x <p>y</p></figcaption></figure>')
    assert [(e["kind"], e["text"], e["ref"], e["caption"], e["medium"]) for e in got] == [("media", None, "a", "cap", "image"), ("text", "text after", None, None, None), ("media", None, "b", "x y", "audio")]
    assert interleaved.parse("a<figure>b<figcaption>never closed")[-1]["text"] == "b"


def brute_sequence(text, caption):
    """(position of the whole image, its parts) by a plain count of elements."""
    lines = text.split("\n")
    rows = max(1, -(-len(text.encode()) // 64))
    parts = [(r, min(64, rows - r)) for r in range(0, rows, 64)] if rows > 64 else []
    data = text.encode() + bytes(rows * 64 - len(text.encode()))
    place, whole, out, upto, todo = 0, None, [], 0, list(enumerate(parts))
    for i, line in enumerate(lines):
        place += bool(line.split())
        upto += len(line.encode()) + 1
        while todo and (i == len(lines) - 1 or (todo[0][1][0] + todo[0][1][1]) * 64 <= upto):
            k, (first, n) = todo.pop(0)
            out.append((place, f"{caption or ''} {k + 1}/{len(parts)}".strip(), first, n, zlib.crc32(data[first * 64 : (first + n) * 64][-64:])))
            place += 1
        if i == (len(lines) - 1) // 2:
            whole, place = place, place + 1
    return whole, out


def test_positions_captions_and_parts_stay_aligned(spark):
    docs = queries.read(spark, SF, "documents").select("doc_id", "text", "source").collect()
    got = {r["doc_id"]: r for r in queries.op4_interleaved_media(spark, SF).collect()}
    several = 0
    for d in docs:
        r = got[d["doc_id"]]
        whole, parts = brute_sequence(d["text"] or "", d["source"])
        assert (r["position"], r["caption"]) == (whole, d["source"])
        assert [tuple(f) for f in r["figures"]] == parts
        several += len(parts) > 1 and whole > 0
    assert several > 5


def test_escaped_and_blank_lines(spark):
    text = "\n".join(["<b>&amp; x</b>", "", "  ", "y" * 5000, "<figure>", "é" * 4000, "end"])
    df = spark.createDataFrame([(7, text, "<s>"), (8, text, None)], "doc_id long, text string, source string")
    for r in interleaved.media_columns(df).collect():
        whole, parts = brute_sequence(text, "<s>" if r["doc_id"] == 7 else None)
        assert r["position"] == whole and [tuple(f) for f in r["figures"]] == parts and len(parts) == 4
