"""The maintained lexical index against an index built from all texts."""

import glob
import random

import pytest


from docquarry.operators import index, lexical, lexical_store
from docquarry.sources.versions import VersionedTables

CHUNKS = "kb_id string, doc_id string, chunk_id string, ordinal long, text string"
QUESTIONS = "kb_id string, query_id long, question string"
SETTINGS = {"buckets": 8, "width": 8}


def chunk_rows(seed, documents):
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(40)]
    rows = []
    for d in documents:
        kb = "a" if d % 5 else "b"
        for c in range(2):
            # Word 0 is in nearly every chunk; its weight is a share of the mean.
            picked = ["w0"] * rng.randrange(3) + [rng.choice(words[: rng.choice((5, 40))]) for _ in range(rng.randrange(0, 12))]
            rows.append((kb, f"d{d}", f"d{d}c{c}", 2 * d + c, " ".join(picked) if d % 11 else None))
    return rows


ASKED = [("a", n, q) for n, q in enumerate(["w1 w2 w3", "w0", "w39 w38 w0 w0", "unknown", "", "w7 w7 w30", None])] + [("b", 50, "w1 w9"), ("c", 51, "w1")]


def top(questions, lex, n):
    rows = lexical.top_chunks(questions, lex, n).collect()
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 8), round(r["bm25"], 8)) for r in rows)


def agree(spark, path, rows, questions, n=4):
    scan = index.build_lexical_index(spark.createDataFrame(rows, CHUNKS))
    for wanted in (None, questions):
        stored = lexical_store.read(spark, path, wanted, buckets=8)
        assert top(questions, stored, n) == top(questions, scan, n)
    terms = lambda lex: sorted((r["kb_id"], r["term"], r["df"], round(r["idf"], 9)) for r in lex.terms.collect())
    stats = lambda lex: sorted((r["kb_id"], r["n"], round(r["avgdl"], 9)) for r in lex.stats.collect())
    assert terms(stored) == terms(scan) and stats(stored) == stats(scan)


@pytest.mark.parametrize("n", [4, 90])
def test_uploads_and_removals_equal_the_scan(spark, tmp_path, n):
    path = str(tmp_path / "store")
    questions = spark.createDataFrame(ASKED, QUESTIONS)
    first, second = chunk_rows(1, range(60)), chunk_rows(2, range(50, 70))
    lexical_store.update(spark, path, spark.createDataFrame(first, CHUNKS), **SETTINGS)
    agree(spark, path, first, questions, n)
    # Documents 50 to 59 get new texts, 60 to 69 are new, 0 to 4 go.
    gone = [(kb, doc) for kb, doc, *_ in first if doc in {f"d{d}" for d in range(5)}] + [("a", "never there")]
    lexical_store.update(
        spark, path, spark.createDataFrame(second, CHUNKS), spark.createDataFrame(gone, "kb_id string, doc_id string"), **SETTINGS
    )
    replaced = {(r[0], r[1]) for r in second} | set(gone)
    left = [r for r in first if (r[0], r[1]) not in replaced] + second
    agree(spark, path, left, questions, n)


def test_an_upload_writes_the_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("a", f"d{n}", f"c{n}", n, f"word{n} common") for n in range(60)]
    lexical_store.update(spark, path, spark.createDataFrame(rows, CHUNKS), buckets=64, width=8)
    lexical_store.update(spark, path, spark.createDataFrame([("a", "d7", "c7", 7, "word7 common extra")], CHUNKS), buckets=64, width=8)
    now = VersionedTables(spark, path, lexical_store.layouts(64)).snapshot()
    changed = [k for k, since in now.held.items() if since == 1]
    # The bucket of the document, those of three terms at most, and that of the base.
    assert len(changed) <= 5 and len(now.held) > 60
    lexical_store.update(spark, path, removed=spark.createDataFrame([r[:2] for r in rows], "kb_id string, doc_id string"), buckets=64, width=8)
    empty = lexical_store.read(spark, path, buckets=64)
    assert empty.chunks.count() == empty.postings.count() == empty.stats.count() == 0
    assert top(spark.createDataFrame(ASKED, QUESTIONS), empty, 3) == []


def test_bounds_leave_ranges_out(spark, tmp_path, monkeypatch):
    """A rare term's chunks are in few ranges; the ranges of a common term are not scored."""
    path = str(tmp_path / "store")
    rows = [("a", f"d{n}", f"c{n}", n, "common " + ("rare " * 3 if n in (3, 90, 150) else f"other{n}")) for n in range(400)]
    lexical_store.update(spark, path, spark.createDataFrame(rows, CHUNKS), buckets=4, width=10)
    questions = spark.createDataFrame([("a", 1, "rare common")], QUESTIONS)
    stored = lexical_store.read(spark, path, questions, buckets=4)
    weighted = lexical.weighted_terms(questions, stored, ship=True)
    scored = lexical_store.best_of_blocks(weighted, stored.blocks, 3, lexical.Bm25Params(), 10)
    assert scored.count() <= 10 * lexical_store.FIRST_RANGES
    assert top(questions, stored, 3) == top(questions, index.build_lexical_index(spark.createDataFrame(rows, CHUNKS)), 3)


def test_an_update_leaves_only_what_the_index_needs(spark, tmp_path):
    """Old versions and the tables of an update go; an entry holds no names, so that little moves."""
    path = str(tmp_path / "store")
    first = [("a", f"d{n}", f"c{n}", n, "common " + f"w{n % 3} " * (n % 4)) for n in range(40)]
    again = [(kb, doc, chunk, place, f"{text} again") for kb, doc, chunk, place, text in first[10:30]]
    lexical_store.update(spark, path, spark.createDataFrame(first, CHUNKS), buckets=2, width=8, keep=1)
    lexical_store.update(spark, path, spark.createDataFrame(again, CHUNKS), buckets=2, width=8, keep=1)
    assert [p.name for p in (tmp_path / "store" / "data" / "postings").iterdir()] == ["version=1"]
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not glob.glob(f"{root}/lexical-update-*")
    stored = lexical_store.read(spark, path, buckets=2)
    found = {(r["chunk_id"], r["term"]): (r["doc_id"], r["dl"], r["tf"]) for r in stored.postings.collect()}
    expected = {}
    for _, doc, chunk, _, text in first[:10] + again + first[30:]:
        words = text.split()
        expected |= {(chunk, word): (doc, len(words), words.count(word)) for word in words}
    assert found == expected
    heads = stored.blocks.collect()
    assert {tuple(e.asDict()) for r in heads for e in r["entries"]} == {("ordinal", "dl", "tf")}
    assert len(heads) == len({(r["term"], r["range"]) for r in heads})
    for r in heads:
        assert (r["n"], r["max_tf"], r["min_dl"]) == (len(r["entries"]), max(e["tf"] for e in r["entries"]), min(e["dl"] for e in r["entries"]))
