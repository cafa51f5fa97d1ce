import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import distinctive, encoding, splitting

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def exact():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(encoding.TOKENIZER, "rb"))}
    return tiktoken.Encoding("own", pat_str=encoding.SPLIT, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return encoding.Encoder(encoding.load_ranks(encoding.TOKENIZER))


SAMPLES = ["", None, " ", "\n\n  x", "aaaaaaaaaaaaaaaaaaaaaaa", "don't we'll", "naïve café – 12345", "日本語の文", "👩‍💻✅", "<|endoftext|>", "a" * 5000, "ab" * 4000, " 　 \t"]


def test_ids_equal_the_library(exact, encoder):
    assert encoder(SAMPLES) == [exact.encode_ordinary(t) if t else [] for t in SAMPLES]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_ids_of_any_text(exact, encoder, texts):
    texts = [t for t in texts if not re.search("[\ud800-\udfff]", t)]
    assert encoder(texts) == [exact.encode_ordinary(t) for t in texts]


def test_encode_frame(spark, exact):
    rows = [(i, t, 1) for i, t in enumerate(SAMPLES)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encoding.encode(df).collect()}
    assert got == {i: exact.encode_ordinary(t) if t else [] for i, t, _ in rows}
    sizes = {r.doc_id: r.n_tokens for r in encoding.encode(df, lengths_only=True).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
    assert encoding.encode(df.limit(0)).count() == 0


def brute_cuts(text, limit, overlap, header, quoted):
    value = splitting.strengths(np.frombuffer(text.encode("utf-32-le"), np.uint32), quoted)
    pieces, start, last, later = [], 0, 0, max(1, limit - header)
    while True:
        room = limit if not start else later
        if len(text) - start <= room:
            return [*pieces, (start, len(text))]
        back = min(max(0, overlap), later - 1)
        window = range(max(start + min(room, max(back + 1, (room + 1) // 2)), last + 1), start + room + 1)
        last = max(window, key=lambda i: (value[i], i))
        pieces.append((start, last))
        whole = [i for i in range(last - back, start - 1, -1) if value[i] != splitting.INSIDE]
        start = whole[0] if whole and whole[0] + later > last else last - back


@settings(max_examples=200, deadline=None)
@given(st.text("ab ,.\n\r\f\"。é́👩‍", max_size=300), st.integers(1, 40), st.integers(-1, 50), st.integers(0, 10), st.booleans())
def test_cuts_equal_brute_force(text, limit, overlap, header, quoted):
    got = splitting.cut_points(text, limit, overlap, header, quoted)
    assert got == brute_cuts(text, limit, overlap, header, quoted)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b in got) and all(y[0] <= x[1] and y[1] > x[1] for x, y in zip(got, got[1:]))


def test_long_text_uses_many_tables():
    text = "word and. " * 30_000
    got = splitting.cut_points(text, 100, 7)
    assert got == brute_cuts(text, 100, 7, 0, False)


def test_boundaries():
    assert splitting.cut_points("aaa bbb. ccc\n\nddd eee", 16, 0) == [(0, 14), (14, 21)]
    assert splitting.cut_points("one two. three four", 12, 2) == [(0, 9), (7, 19)]
    assert splitting.cut_points("aaaa\fbbb\n\nc", 10, 0) == [(0, 5), (5, 11)]
    assert splitting.cut_points("é" * 5, 3, 0) == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 10)]


def test_overlap_starts_with_a_whole_character():
    text = "aa e\u0301e\u0301e\u0301 bbb cc e\u0301e\u0301 d"
    for limit in range(6, 14):
        for overlap in range(1, 5):
            assert all(a == 0 or text[a] != "\u0301" for a, _ in splitting.cut_points(text, limit, overlap))


def test_short_pieces_where_the_share_allows():
    text = "aaaa\fbbbb cccc dddd"
    assert splitting.cut_points(text, 15, 0)[0] == (0, 15) and splitting.cut_points(text, 15, 0, least_share=0.2)[0] == (0, 5)


def test_headers_of_any_length_are_kept():
    for header in ("a,b", "long,column,header", "x" * 39, "many words in a header " * 5):
        got = splitting.pieces_of("row\n" * 40, 40, 3, header, True)
        assert all(len(p) <= 40 for _, _, p in got)
        text = [(a, b) for a, b, _ in got if b]
        assert text[0][0] == 0 and text[-1][1] == 160 and all(y[0] <= x[1] for x, y in zip(text, text[1:]))
        alone = [p for _, b, p in got if not b]
        assert "".join(alone).replace(" ", "").startswith(header.replace(" ", "")[:20]) if alone else all(p.startswith(header + "\n") for _, _, p in got[1:])


SEG = "seg_id long, file string, seg_no int, page int, sheet string, slide int, text string, column_headers string, piece int, format string"
LIM = "format string, max_chars int, overlap_chars int"


def test_split_segments(spark):
    csv = "h1,h2\n" + "".join(f'{i},"a\nb"\n' for i in range(20))
    rows = [
        (1, "d/a.XLSX", 1, None, "S", None, csv, "h1,h2", 1, "x"),
        (2, "d/a.txt", 2, 3, None, None, "x" * 50, None, 1, "x"),
        (3, "d/a.txt", 2, 3, None, None, None, None, 1, "x"),
        (4, None, None, None, None, 7, "y" * 31, None, 1, "x"),
        (5, "d/a.txt", 2, 3, None, None, "👩" * 20, None, 1, "x"),
        (6, "d/a.txt", 2, 3, None, None, "", None, 1, "x"),
    ]
    limits = spark.createDataFrame([("xlsx", 40, 0), ("txt", 20, 5), ("other", 30, 0)], LIM)
    pieces = splitting.split_segments(spark.createDataFrame(rows, SEG), limits)
    got = {}
    for r in pieces.orderBy("seg_id", "piece_no").collect():
        got.setdefault(r.seg_id, []).append(r)
    assert sorted(got) == [1, 2, 4] and sorted(r.seg_id for r in splitting.oversized(pieces).collect()) == [1, 2, 4]
    assert all(p.piece.startswith("h1,h2\n") and len(p.piece) <= 40 and p.piece.count('"') % 2 == 0 for p in got[1])
    assert "".join(csv[p.start : p.end] for p in got[1]) == csv
    assert [(p.start, p.end, p.page) for p in got[2]] == [(0, 20, 3), (15, 35, 3), (30, 50, 3)] and got[4][0].slide == 7
    assert splitting.split_segments(spark.createDataFrame([], SEG), limits).count() == 0
    assert splitting.split_segments(spark.createDataFrame(rows, SEG), limits.limit(0)).count() == 0


TERMS = "page_id long, title_terms array<string>, tag_terms array<string>, body_terms array<string>, term string, df int"


def test_log_entropy_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "The,", "ｔｈｅ", "x1", " rare ", "--", "", None, "a-b", "(Ünïcode)"] + [f"w{i}" for i in range(20)]
    rows = [(i, [rng.choice(words) for _ in range(rng.randint(0, 9))], None, [rng.choice(words) for _ in range(30)], "t", 1) for i in range(25)]
    rows += [rows[3], (99, None, None, None, None, None), (98, [], [None], [""], None, None)]
    clean = lambda t: re.sub(r"^[\W_]+|[\W_]+$", "", t.replace("ｔｈｅ", "the").lower()) if t else ""
    counts = {}
    for i, r in {str(r): (r[0], r) for r in rows}.values():
        counts[i] = Counter(c for part in r[1:4] for t in part or [] if (c := clean(t)))
    n = sum(bool(c) for c in counts.values())
    want = {}
    for i, c in counts.items():
        for t, k in c.items():
            all_ = [x[t] for x in counts.values() if t in x]
            gf = sum(all_)
            h = math.log(gf) - sum(x * math.log(x) for x in all_) / gf
            want[i, t] = (k, len(all_), gf, round(math.log1p(k) * max(0, 1 - h / math.log(n)), 6))
    counted = distinctive.term_counts(spark.createDataFrame(rows, TERMS), "page_id", ["title_terms", "tag_terms", "body_terms"])
    weighted = distinctive.log_entropy(counted, "page_id")
    got = {(r.page_id, r.term): (r.tf, r.df, r.gf, round(r.weight, 6)) for r in weighted.collect()}
    assert got.keys() == want.keys() and all(got[k][:3] == want[k][:3] and abs(got[k][3] - want[k][3]) < 1e-5 for k in want)
    found = {tuple(r) for r in distinctive.distinctive(weighted, "page_id").collect()}
    assert found == {k for k, v in want.items() if v[0] >= 4 and v[1] <= 3}
    empty = distinctive.term_counts(spark.createDataFrame([], TERMS), "page_id", ["title_terms"])
    assert distinctive.log_entropy(empty, "page_id").count() == 0
