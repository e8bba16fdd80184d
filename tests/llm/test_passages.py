import random

import numpy as np
import pyarrow as pa

from palimpsest.llm import passages


def test_windows_are_the_cartesian_nodes():
    rng = np.random.default_rng(3)
    for top in (4, 40, 1 << 60):
        sizes = [0, 3, 8, 30, 1, 100]
        v = rng.integers(0, top, sum(sizes)).astype(np.uint64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        want = set()
        for s, e in zip(at[:-1], at[1:]):
            runs = {}
            for p in range(s, e - 8 + 1):
                part = v[p : p + 8]
                runs.setdefault(int(p + 7 - part[::-1].argmin()), []).append(p)
            want |= {(c, min(r), max(r)) for c, r in runs.items()}
        got = list(zip(*(x.tolist() for x in passages.compact_windows(v, at, 8))))
        assert set(got) == want and len(got) == len(want)


def corpus(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    hot, line = text(60), text(12)
    rows, planted = [], {}
    for i in range(120):
        w = text(rng.choice([0, 10, 80, 300]))
        if i % 5 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = line
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = hot
            planted[i] = (at, at + 60)
        rows.append((i, " ".join(w)))
    near = list(hot)
    near[30] = "changed"
    rows.append((120, " ".join(text(50) + near + text(50))))
    planted[120] = (50, 110)
    copy = " ".join(text(100))
    rows += [(121, copy), (122, copy.upper()), (123, None), (124, ""), (125, "w " * 20_000), (126, "y " * 20_000)]
    planted |= {121: (0, 100), 122: (0, 100)}
    return rows, planted


def test_planted_passages_and_clean_documents(spark):
    rows, planted = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, rows[0][1], "x")], "doc_id long, text string, similarity string")
    got = passages.shared_passages(df.repartition(6)).collect()
    assert {r["doc_id"] for r in got} == set(planted)
    for i, (s, e) in planted.items():
        assert any(r["start_word"] <= s + 3 and r["end_word"] >= e - 3 for r in got if r["doc_id"] == i), i
    texts = {i: (t or "").lower().split() for i, t in rows}
    for r in got:
        a, b = texts[r["doc_id"]][r["start_word"] : r["end_word"]], texts[r["rep_doc_id"]][r["rep_start_word"] : r["rep_end_word"]]
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        assert len(a) > 50 and abs(len(x & y) / len(x | y) - r["similarity"]) < 1e-9 and r["similarity"] >= 0.8


def test_odd_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert passages.shared_passages(df).collect() == []
    text = " ".join(map(str, range(60)))
    df = spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string")
    assert passages.shared_passages(df).collect() == []


def test_rows_that_repeat_an_id_lose_nothing(spark):
    rng = random.Random(9)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    p, q, u = text(60), text(70), text(55)
    rows = [(1, p), (2, text(9) + p), (2, q + text(4)), (3, text(7) + q), (3, u), (3, u), (3, u + text(5)), (4, text(80))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["rep_doc_id"]) for r in passages.shared_passages(df).collect()}
    found = {(i, s, e) for i, s, e, _ in got}
    assert found == {(1, 0, 60), (2, 9, 69), (2, 0, 70), (3, 7, 77), (3, 0, 55)}
    assert {(i, s, e) for i, s, e, rep in got if rep == 3} == {(3, 0, 55)} and passages.shared_passages(df).columns == passages.COLUMNS


def test_scattered_minima_do_not_hide_a_passage(spark):
    """Documents 2 and 3 share a passage; the smaller document 1 holds its shingles, scattered."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    shared = text(80)
    scattered = [w for i in range(0, 76, 4) for w in shared[i : i + 8] + text(60)]
    rows = [(1, " ".join(scattered)), (2, " ".join(text(30) + shared + text(30))), (3, " ".join(text(9) + shared))]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got if r["similarity"] == 1} == {(2, 30, 110), (3, 9, 89)}


def test_later_occurrences_in_the_first_document(spark):
    rng = random.Random(6)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    shared, alone = text(60), text(60)
    rows = [(1, " ".join(shared + text(20) + shared + alone + text(9) + alone)), (2, " ".join(text(5) + shared))]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in got) == [(1, 0, 60), (1, 80, 140), (2, 5, 65)]


def edited(rng, words, every, start=0):
    return [f"e{rng.random()}" if i >= start and i % every == every - 1 else w for i, w in enumerate(words)]


def test_near_stretch_in_a_run_below_the_threshold():
    """60 words with one edit, and then an edit every 12 words."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    other = edited(rng, words, 12, start=60)
    other[30] = "changed"
    x, y = (np.array([hash(tuple(w[i : i + 5])) & (1 << 63) - 1 for i in range(len(w) - 4)], np.uint64) for w in (words, other))
    got = passages.shared_runs(x, y, [0], passages.SPAN, 0.8)
    assert any(b <= 0 and e >= 55 and share >= 0.8 for _, _, b, e, share in got)


def test_recall_at_the_least_length(spark):
    """Passages of exactly 51 words with one word changed in the middle: Jaccard 42/52."""
    rng = random.Random(8)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows = []
    for i in range(300):
        p = text(51)
        q = p[:25] + ["changed"] + p[26:]
        rows += [(2 * i, " ".join(text(40) + p + text(40))), (2 * i + 1, " ".join(text(40) + q + text(40)))]
    got = {r["doc_id"] for r in passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) >= 0.99 * 600


def family(rng, size=6, length=51):
    """Passages of a family, apart from each other (0.52 similar to the original), the original, and a copy
    with one word changed (0.81 similar to it)."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    p = [word() for _ in range(length)]
    out = []
    for _ in range(size):
        q = list(p)
        for k in rng.sample((6, 9, 12), 1)[0], rng.choice((22, 25, 28)), rng.choice((38, 41, 44)):
            q[k] = word()
        out.append(q)
    return [*out, p, [*p[:25], word(), *p[26:]]]


def test_near_copies_after_others_of_their_family(spark):
    """A near pair is found though earlier documents hold most of its minima, but not it."""
    rng = random.Random(12)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows, pairs = [], []
    for _ in range(60):
        for q in family(rng):
            rows.append((len(rows), " ".join(text(40) + q + text(40))))
        pairs.append((len(rows) - 2, len(rows) - 1))
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("similarity < 1").collect()
    found = {(r["rep_doc_id"], r["doc_id"]) for r in got}
    assert sum(p in found for p in pairs) >= 57


def brute(texts, span=passages.SPAN):
    """Pairs of documents with spans of ``span`` shingles that start at shifts near each other and are at
    least 0.8 similar: every span of one against every span of the other."""
    sets = {}
    for i, t in texts.items():
        sh = [tuple(t[k : k + 5]) for k in range(len(t) - 4)]
        sets[i] = [frozenset(sh[k : k + span]) for k in range(len(sh) - span + 1)]
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if any(len(x & y) >= 0.8 * len(x | y) for x in sets[a] for y in sets[b])}


def test_all_near_passages_of_a_small_table(spark):
    """Every document that brute force finds in a near pair has a row, and every pair of one row is such a pair."""
    rng = random.Random(21)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    texts = {}
    for _ in range(8):
        for q in family(rng, 3, 60):
            texts[len(texts)] = text(12) + q + text(9)
    got = passages.shared_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()
    want = brute(texts)
    pairs = {(r["rep_doc_id"], r["doc_id"]) for r in got} - {(i, i) for i in texts}
    assert want and {i for p in want for i in p} == {r["doc_id"] for r in got} and pairs <= want


def test_tokens_travel_for_pairs_alike_in_prints_only():
    rng = random.Random(8)
    x = np.array([rng.getrandbits(64) for _ in range(90)], np.uint64)
    near = x[20:70].copy()
    near[[10, 30]] = [rng.getrandbits(64) for _ in range(2)]
    others = [np.array([rng.getrandbits(64) for _ in range(n)], np.uint64) for n in (90, 50)]
    few = np.concatenate([x[:30], others[1]])
    short = lambda t: (t >> np.uint64(48)).astype(np.uint16).tobytes()
    rows = [x, near, few, *others, x[:0]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([short(x)] * len(rows)), pa.array([short(y) for y in rows])], names=["n", "x", "y"])
    kept = [n for out in passages.alike(iter([batch]), passages.SIMILARITY * passages.SPAN) for n in out.column(0).to_pylist()]
    assert kept == [0, 1]
    found = [n for n, y in enumerate(rows) if passages.shared_runs(x, y, [], passages.SPAN, passages.SIMILARITY)]
    assert set(found) <= set(kept)


def test_excerpts_hold_the_prints_of_their_tokens():
    text = " ".join(f"w{i}" for i in range(80))
    regions = pa.array([[{"lo": 3, "hi": 60}, {"lo": 70, "hi": 500}]])
    (out,) = passages.excerpts(iter([pa.RecordBatch.from_arrays([pa.array([5]), pa.array([text]), regions], names=["id", "text", "regions"])]))
    tokens, prints = ([np.frombuffer(b, t) for b in out.column(c).to_pylist()] for c, t in (("tokens", np.uint64), ("prints", np.uint16)))
    assert [len(t) for t in tokens] == [58, 6]
    assert all(np.array_equal((t >> np.uint64(48)).astype(np.uint16), p) for t, p in zip(tokens, prints, strict=True))


def plain_windows(rng, docs):
    """Shared windows of random documents under six hash functions, as ``met`` has them."""
    rows = []
    for i in range(docs):
        n, m = rng.randint(60, 400), []
        for k in range(passages.HASHES):
            v = np.array([rng.getrandbits(40) for _ in range(n)], np.uint64)
            for place, first, last in zip(*(x.tolist() for x in passages.compact_windows(v, np.array([0, n]), passages.SPAN))):
                if rng.random() < 0.5:
                    pos = (place << 16) | ((place - first) << 8) | (last + passages.SPAN - 1 - place)
                    m.append({"key": (rng.getrandbits(50) << 3) | k, "pos": pos, "a": rng.randint(0, 3), "apos": rng.randint(0, 300) << 16})
        found = [{"s": s, "e": s + rng.randint(40, 120), "equal": rng.random() < 0.5, "rep": rng.random() < 0.5} for s in (rng.randint(0, n) for _ in range(rng.randint(0, 3)))]
        rows.append((i, m, found or None))
    return [r for r in rows if r[1]]


def table(rows):
    window = pa.list_(pa.struct([(c, pa.int64()) for c in ("key", "pos", "a", "apos")]))
    place = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("equal", pa.bool_()), ("rep", pa.bool_())]))
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), window, place), strict=True)], names=["id", "m", "found"])


def test_documents_are_counted_side_by_side():
    """Numpy works on many documents at once, and what it finds of each is what it finds of that one alone."""
    rows = plain_windows(random.Random(31), 200)
    batch = table(rows)
    runs = list(passages.shared_windows(batch, passages.SPAN))
    assert len(runs) < 20 and sum(part.stop - part.start for part, _ in runs) == len(rows)
    for part, w in runs:
        for d, (_, m, _) in enumerate(rows[part]):
            starts = {}
            for r in m:
                c, left, right = r["pos"] >> 16, (r["pos"] >> 8) & 255, r["pos"] & 255
                for s in range(c - left, c + right - passages.SPAN + 2):
                    starts.setdefault(s, set()).add(r["key"] & 7)
            place = np.arange(w.edge[d], w.edge[d + 1]) - w.shift[d]
            assert w.count[w.edge[d] : w.edge[d + 1]].tolist() == [len(starts.get(int(s), ())) for s in place]
    for step in (lambda it: passages.supported((b.select([0, 1]) for b in it), passages.SPAN, 2), lambda it: passages.left_over(it, passages.SPAN, passages.HASHES)):
        listed = lambda it: sorted(map(repr, (r for out in step(it) for r in out.to_pylist())))  # noqa: B023, E731
        assert listed(iter([batch])) == listed(table([r]) for r in rows) != []


def test_equal_stretches_of_many_pairs_at_once(monkeypatch):
    rng = random.Random(32)
    monkeypatch.setattr(passages, "AT_A_TIME", 700)
    pairs, want = [], []
    for n in range(40):
        x = [rng.getrandbits(64) for _ in range(rng.randint(0, 200))]
        y = [rng.getrandbits(64) for _ in range(rng.randint(0, 50))] + x[rng.randint(0, 60) :]
        for _ in range(rng.randint(0, 2)):
            y[rng.randrange(len(y)) : len(y)] = y[rng.randrange(len(y)) :] if y else []
        pairs.append((x, y, sorted(rng.sample(range(-60, 60), 30))))
        for s in pairs[-1][2]:
            same = [0 <= i + s < len(y) and x[i] == y[i + s] for i in range(len(x))] + [False]
            first = 0
            for i, one in enumerate(same):
                if not one:
                    want += [(n, s, first, i)] if i - first >= passages.SPAN else []
                    first = i + 1
    at = lambda k: np.cumsum([0, *(len(p[k]) for p in pairs)])
    x, y = (np.array([t for p in pairs for t in p[k]], np.uint64) for k in (0, 1))
    pair, shift = np.repeat(np.arange(40), 30), np.array([s for p in pairs for s in p[2]])
    k, first, end = passages.equal_runs(x, y, at(0), at(1), pair, shift, passages.SPAN)
    assert list(zip(pair[k].tolist(), shift[k].tolist(), first.tolist(), end.tolist())) == want != []


def test_words_are_sums_of_their_bytes():
    from palimpsest.llm import _words

    texts = ["", "a", "Ab \t c", "é" * 40 + " x", *(f"{'x' * n} y{'z' * n}" for n in (1, 2, 31, 63, 64, 65, 130)), None, "end"]
    raw, starts, ends = _words.utf8(pa.array(texts))
    h, at = _words.words(raw, starts, ends)
    split = [w for t in texts for w in (t or "").lower().split()]
    base, mask = int(_words.BASE), (1 << 64) - 1
    sums = [(sum(int(_words.BYTE[c]) * pow(base, k, 1 << 64) for k, c in enumerate(w.encode())) + len(w.encode()) * int(_words.STEP)) & mask for w in split]
    assert h.tolist() == _words.mix(np.array(sums, np.uint64)).tolist()
    assert np.diff(at).tolist() == [len((t or "").split()) for t in texts]
