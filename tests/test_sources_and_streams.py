import json

import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql import functions as F

from docquarry import schemas
from docquarry.params import AdmissionLimits, ChunkParams
from docquarry.sources import appended, files, json_arrays, jsonl, papers
from docquarry.sources.versions import Layout, VersionedTables
from docquarry.streaming import logs, sessions, uploads

LINE = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])


@pytest.fixture
def mixed(tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n\n   \n{"a": true, "b": "y"}\n{"a": 2\n{"a": 3, "b": "z"}\n')
    return str(path)


def test_lenient_and_strict_lines(spark, mixed, rows, tmp_path):
    lines = jsonl.read_lenient(spark, mixed, LINE).cache()
    assert rows(jsonl.well_formed(lines)) == [(1, "x"), (3, "z")]
    assert jsonl.malformed_count(lines).first()[0] == 2
    numbered = jsonl.malformed_lines(spark, mixed, LINE)
    assert rows(numbered, "line_number", "line") == [(4, '{"a": true, "b": "y"}'), (5, '{"a": 2')]
    with pytest.raises(ValueError, match="line 4 of .*log.jsonl"):
        jsonl.check_lines(spark, mixed, LINE)
    with pytest.raises(Exception):
        jsonl.read_strict(spark, mixed, LINE).collect()
    array = tmp_path / "array.jsonl"
    array.write_text('[{"a": 2, "b": "x"}, {"a": 3, "b": "y"}]\n')
    with pytest.raises(Exception, match="array.jsonl"):
        jsonl.read_strict(spark, str(array), LINE).collect()
    assert [r["_corrupt"] for r in jsonl.read_lenient(spark, str(array), LINE).collect()] == [array.read_text().strip()]
    good = tmp_path / "good.jsonl"
    good.write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": "y"}\n')
    ordered = jsonl.with_line_order(jsonl.read_strict(spark, str(good), LINE)).orderBy("line_order")
    assert [r["a"] for r in ordered.collect()] == [1, 2]


def test_append_and_replace(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], LINE)
    path = str(tmp_path / "x")
    for n in (1, 2):
        jsonl.append(df, path)
        assert jsonl.read_strict(spark, path, LINE).count() == n
    jsonl.write_artifact(df, path)
    assert jsonl.read_strict(spark, path, LINE).count() == 1


def test_file_digests(spark, tmp_path):
    import hashlib

    (tmp_path / "a.pdf").write_bytes(b"\x00\xffdata")
    got = files.read_fingerprints(spark, str(tmp_path)).first()
    assert got["fingerprint"] == hashlib.md5(b"\x00\xffdata").hexdigest()
    assert got["sha256"] == hashlib.sha256(b"\x00\xffdata").hexdigest()


def test_saved_papers(spark, tmp_path):
    annotation = dict(unanswerable=False, extractive_spans=["s"], yes_no=None, free_form_answer="", evidence=[], highlighted_evidence=[])
    qas = dict(
        question=["why", "how"], question_id=["1", "2"], nlp_background=["", ""], topic_background=["", ""], paper_read=["", ""],
        search_query=["", ""], question_writer=["", ""],
        answers=[dict(answer=[annotation], annotation_id=["a"], worker_id=["w"])] * 2,
    )
    (tmp_path / "p.json").write_text(json.dumps([dict(id="x", qas=qas), dict(id="y", qas=qas)]))
    got = papers.read_saved_papers(spark, str(tmp_path)).collect()
    assert [(r["paper_ordinal"], r["id"], r["qas"]["question"]) for r in got] == [(0, "x", ["why", "how"]), (1, "y", ["why", "how"])]
    assert schemas.answer_attempts()["gold_answers"] and schemas.request_log() and schemas.judge_attempts()


LOG = "conversation_id string, retrieval struct<retrieval_relevance:string,relevance_explanation:string>, generation struct<groundedness_label:string,groundedness_explanation:string>"


def test_tail_continues_from_its_checkpoint(spark, tmp_path, rows):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    run = spark.createDataFrame([("c1",)], "conversation_id string")

    def arrive(data):
        spark.createDataFrame(data, LOG).coalesce(1).write.mode("append").json(source)
        stream = logs.tail(spark, source, spark.createDataFrame([], LOG).schema)
        logs.write_available(logs.run_logs(stream, run), out, check)
        return rows(spark.read.parquet(out), "conversation_id", "retrieval.relevance_explanation")

    one = ("c1", ("unknown", "429 tpm"), ("grounded", "by a@b.org"))
    assert arrive([one, ("c2", ("high", "x"), ("grounded", "y"))]) == [("c1", "Checker request failed: rate_limit_tpm (HTTP 429).")]
    assert len(arrive([one])) == 2


def test_windowed_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    data = [("2024-01-01 00:10:00", ("high", "x"), ("unknown", "y")), ("2024-01-01 01:10:00", ("high", "x"), (" ", "y"))]
    frame = spark.createDataFrame(data, "t string, " + LOG.split(", ", 1)[1]).withColumn("ts", F.to_timestamp("t"))
    frame.write.parquet(source)
    stream = spark.readStream.schema(frame.schema).parquet(source)
    counts = logs.windowed_availability(stream, "ts", "1 hour", "10 minutes")
    logs.update_table(counts, str(tmp_path / "out"), str(tmp_path / "check"))
    got = logs.read_totals(spark, str(tmp_path / "out"))
    assert sorted((r["role"], r["state"], r["count"]) for r in got.collect()) == [("groundedness", "unknown", 1), ("relevance", "valid", 1), ("relevance", "valid", 1)]


def test_uploads_are_indexed_once(spark, tmp_path, rows):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for data in ([("k", 1, "x"), ("k", 2, "x"), ("k", 3, "y")], [("k", 4, "x"), ("k", 5, "z")]):
        frame = spark.createDataFrame(data, "kb_id string, pos long, fingerprint string")
        frame.write.mode("append").parquet(source)
        uploads.index_uploads(spark.readStream.schema(frame.schema).parquet(source), out, check, ChunkParams(), "pos")
    assert rows(uploads.indexed_uploads(spark, out), "pos", "fingerprint") == [(1, "x"), (3, "y"), (5, "z")]


def test_allowance_carries_over_batches(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for start in (0, 2, 4):
        frame = spark.createDataFrame([("s", start + i, "q") for i in range(2)], "session_id string, n long, question string")
        frame.write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).parquet(source)
        sessions.admit_available(stream, out, check, ["n"], AdmissionLimits(max_questions=3))
    got = spark.read.parquet(f"{out}/admissions").orderBy("n").collect()
    assert [r["admission"] for r in got] == ["admitted"] * 3 + ["over_limit"] * 3


def test_tail_reads_what_was_appended_to_a_seen_file(spark, tmp_path):
    log, out, check = tmp_path / "log.jsonl", str(tmp_path / "out"), str(tmp_path / "check")

    def arrive(data: bytes):
        with log.open("ab") as handle:
            handle.write(data)
        logs.write_available(logs.tail(spark, str(log), LINE), out, check)
        return sorted(r["a"] for r in spark.read.schema(LINE).parquet(out).collect())

    assert arrive(b'{"a": 1}\n{"a": 2}\r\n\n{"a": 3') == [1, 2]
    assert arrive(b"") == [1, 2]
    # The unfinished line ends now; an array, a broken line and one that is not UTF-8 are dropped.
    assert arrive(b'3}\n[{"a": 8}, {"a": 9}]\n{"a":\n{"a": 7, "b": "\xff"}\n{"a": 4}\n') == [1, 2, 4, 33]
    assert arrive(b'{"a": 5}\n' * 3) == [1, 2, 4, 5, 5, 5, 33]
    log.write_bytes(log.read_bytes()[:-9])
    with pytest.raises(Exception, match="shorter than"):
        arrive(b"")


def test_tail_of_a_folder_fails_on_rewritten_and_lost_files(spark, tmp_path):
    folder = tmp_path / "logs"
    (folder / "sub").mkdir(parents=True)
    (folder / "sub" / "a.jsonl").write_text('{"a": 1}\n')
    (folder / "_SUCCESS").write_text("x\n")
    for name, damage, message in (
        ("rewritten", lambda: (folder / "sub" / "a.jsonl").write_text('{"a": 11, "b": "longer"}\n'), "rewritten"),
        ("lost", lambda: (folder / "sub" / "a.jsonl").rename(folder / "sub" / "b.jsonl"), "gone"),
    ):
        out, check = str(tmp_path / f"out-{name}"), str(tmp_path / f"check-{name}")
        logs.write_available(logs.tail(spark, folder.as_uri(), LINE), out, check)
        assert spark.read.parquet(out).count() == 1
        damage()
        with pytest.raises(Exception, match=message):
            logs.write_available(logs.tail(spark, folder.as_uri(), LINE), out, check)


@pytest.mark.parametrize("split_bytes", [1, 2, 3, 7, 50, 1 << 20])
def test_splits_hand_out_every_line_once(tmp_path, split_bytes):
    text = b"\n\nab\n\xc3\xa9\r\n" + b"x" * 40 + b"\n\nlast\nnot ended"
    (tmp_path / "f").write_bytes(text)
    files_ = appended._Files({"path": str(tmp_path), "splitBytes": str(split_bytes)})
    for first, stop in ((0, len(text)), (2, len(text)), (2, len(text) - 9), (0, 1)):
        got = []
        for split in files_.splits({"f": first}, {"f": stop}):
            for batch in files_.read(split):
                got += zip(batch["offset"].to_pylist(), batch["value"].to_pylist())
        want, at = [], first
        for line in text[first:stop].split(b"\n"):
            if at < stop:
                want.append((at, line.removesuffix(b"\r").decode()))
            at += len(line) + 1
        assert got == want


def test_lines_of_a_run_from_recorded_offsets(spark, tmp_path, rows):
    log = tmp_path / "app.jsonl"
    one = {"conversation_id": "c1", "retrieval": {"retrieval_relevance": "high", "relevance_explanation": "x"}}
    log.write_text(json.dumps(one) + "\n")
    recorded = appended.current_offsets(str(log))
    with log.open("ab") as handle:
        handle.write((json.dumps(one) + "\n").encode() * 2 + b'[1]\n"\xff"\n\n{"conversation_id": "c2"}\n{"conv')
    run = spark.createDataFrame([("c1",)], "conversation_id string")
    found, malformed = logs.lines_of_run(spark, str(log), spark.createDataFrame([], LOG).schema, recorded, run)
    assert rows(found, "conversation_id") == [("c1",)] * 2 and malformed.first()[0] == 3
    with pytest.raises(Exception, match="shorter than"):
        appended.lines_since(spark, str(log), {"": 10_000}).count()


def keyed(spark, data):
    return spark.createDataFrame(data, "key string, n long")


def test_versions_replace_touched_buckets_only(spark, tmp_path, rows):
    tables = VersionedTables(spark, str(tmp_path / "t"), {"a": Layout(("key",), 8), "b": Layout(())})
    assert tables.snapshot().version is None and tables.snapshot().read("a") is None
    first = keyed(spark, [(f"k{n}", n) for n in range(40)])
    tables.publish(0, {"a": (first, list(range(8))), "b": (first.limit(3), [0])}, tables.snapshot())
    one = keyed(spark, [("k3", -3), ("k4", -4)])
    touched = tables.layouts["a"].touched(one)
    old = tables.snapshot()
    kept = old.read("a", touched).join(one, "key", "left_anti")
    tables.publish(1, {"a": (kept.unionByName(one), touched)}, old)
    now = tables.snapshot()
    assert {v for (t, b), v in now.held.items() if t == "a" and b in touched} == {1}
    assert {v for (t, b), v in now.held.items() if t == "a" and b not in touched} == {0}
    assert rows(now.read("a")) == sorted(((f"k{n}", -n if n in (3, 4) else n) for n in range(40)), key=repr)
    assert now.read("b").count() == 3 and old.read("a").filter("n < 0").count() == 0
    # A repeated version sees what was before it, and a bucket may become empty.
    again = tables.snapshot(1)
    assert again.version == 0
    tables.publish(1, {"a": (first.limit(0), list(range(8)))}, again)
    assert tables.snapshot().read("a") is None and tables.snapshot().read("b").count() == 3


def test_a_failing_writer_is_not_seen(spark, tmp_path, rows):
    tables = VersionedTables(spark, str(tmp_path / "t"), {"a": Layout(("key",), 4)})
    tables.publish(0, {"a": (keyed(spark, [("x", 1), ("y", 2)]), [0, 1, 2, 3])}, tables.snapshot())
    broken = keyed(spark, [("x", 5), ("y", 6)]).withColumn(
        "n", F.when(F.col("n") == 6, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("n"))
    )
    with pytest.raises(Exception, match="stop"):
        tables.publish(1, {"a": (broken, [0, 1, 2, 3])}, tables.snapshot())
    assert rows(tables.snapshot().read("a")) == [("x", 1), ("y", 2)]
    for version in (1, 2, 3):
        tables.publish(version, {"a": (keyed(spark, [("x", version)]), tables.layouts["a"].touched(keyed(spark, [("x", 0)])))}, tables.snapshot())
    tables.expire(1)
    assert rows(tables.snapshot().read("a")) == [("x", 3), ("y", 2)]
    left = sorted(p.name for p in (tmp_path / "t" / "data" / "a").iterdir())
    assert left == ["version=0", "version=3"]


def test_a_batch_reads_the_buckets_of_its_own_files(spark, tmp_path):
    """After many batches a small one still reads a few files of the state."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    read = []
    for n in range(6):
        frame = spark.createDataFrame([("k", 100 * n + i, f"f{100 * n + i}") for i in range(4)], "kb_id string, pos long, fingerprint string")
        frame.write.mode("append").parquet(source)
        uploads.index_uploads(spark.readStream.schema(frame.schema).parquet(source), out, check, ChunkParams(), "pos")
        state = VersionedTables(spark, f"{out}/state", uploads._KNOWN).snapshot()
        touched = uploads._KNOWN["known"].touched(frame)
        read.append(len(state.read("known", touched).inputFiles()))
        assert state.read("known").count() == 4 * (n + 1)
    assert max(read) <= 4 and uploads.indexed_uploads(spark, out).count() == 24


def test_line_numbers_across_splits_and_files(spark, tmp_path, rows):
    for name, bad in (("a", {3, 500, 2999}), ("b", {1, 2000})):
        lines = ["x" if n in bad else "" if n % 7 == 0 else json.dumps({"a": n}) for n in range(1, 3001)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = rows(jsonl.malformed_lines(spark, str(tmp_path), LINE).selectExpr("right(file, 1)", "line_number"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == sorted([("a", 3), ("a", 500), ("a", 2999), ("b", 1), ("b", 2000)], key=repr)


ARRAY = [1, -2.5e3, "a,]\"é\\", None, True, [], {}, {"k": ["]", {"x": "}"}]}, "long " * 50, [[1], [2, [3]]], 12]


@pytest.mark.parametrize("piece", [1, 2, 5, 64, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_elements_of_arrays(tmp_path, piece, indent):
    path = tmp_path / "a.json"
    path.write_text(" \n" + json.dumps(ARRAY, indent=indent, ensure_ascii=False) + "\n ", encoding="utf-8-sig")
    with pa.OSFile(str(path)) as handle:
        found = list(json_arrays.elements(handle, "a", piece))
    assert [json.loads(e) for e in found] == ARRAY


@pytest.mark.parametrize(
    "text,message",
    [("[]", "empty list"), ("{}", "not hold a list"), ("", "not hold a list"), (" [ ] ", "empty list"), ("[1, 2", "no comma"), ("[1 2]", "no comma"),
     ("[1,]", "Element 1"), ("[{\"a\":}, 3" + " 3" * 50 + "]", "Element 0"), ("[1] 2", "goes on"), ("[tru", "Element 0"), ("[\"x", "Element 0")],
)
@pytest.mark.parametrize("piece", [1, 1 << 20])
def test_files_that_are_no_arrays(tmp_path, text, message, piece):
    path = tmp_path / "a.json"
    path.write_text(text)
    with pytest.raises(json_arrays.JsonArrayError, match=message), pa.OSFile(str(path)) as handle:
        list(json_arrays.elements(handle, "a", piece))


def test_a_large_array_is_read_in_bounded_memory(tmp_path):
    """100 MB of elements; what is held at a time stays a few MB."""
    import tracemalloc

    path = tmp_path / "large.json"
    element = json.dumps({"id": "x" * 50_000})
    with path.open("w") as out:
        out.write("[")
        for n in range(2000):
            out.write(element + ("," if n < 1999 else "]"))
    tracemalloc.start()
    with pa.OSFile(str(path)) as handle:
        count = sum(1 for _ in json_arrays.elements(handle, "large"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 2000 and peak < 12 << 20


def test_saved_papers_without_papers_fail(spark, tmp_path):
    for text, message in (("[]", "empty list"), ("{}", "not hold a list"), ('[{"id": 1, "qas": []}]', "")):
        path = tmp_path / f"{len(text)}.json"
        path.write_text(text)
        with pytest.raises(Exception, match=message):
            papers.read_saved_papers(spark, str(path)).collect()
