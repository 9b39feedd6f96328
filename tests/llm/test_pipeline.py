import corpus_pipeline
import pytest

from docquarry.llm import line_dedup

SF = "/root/testdata/sf0.001"
BENCH = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture
def folder(spark, tmp_path):
    bench = spark.createDataFrame([(1, BENCH)], "item_id bigint, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def docs_of(spark, rows):
    return spark.createDataFrame(
        [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )


def prose(n):
    return " ".join(f"mole{'abcdefghij'[k % 10]}{'klmnopqrst'[(k * k + n) % 10]}tar{n}x" for k in range(40))


ROWS = [
    (1, prose(1), "aa"),
    (2, prose(1), "aa"),
    (3, prose(3) + "\nshared line of seven words in all\n", "aa"),
    (4, prose(4) + "\nshared line of seven words in all\n", "aa"),
    (5, "start " + BENCH.upper() + " end", "aa"),
    (6, None, "aa"),
    (7, "123 ---", "aa"),
    (8, prose(8), None),
    (9, "", "aa"),
]


def test_each_stage_decides(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    docs = docs_of(spark, ROWS)
    known = stages["language_id"](spark, docs, folder)
    assert sorted(r.doc_id for r in known.collect()) == [1, 2, 3, 4, 5, 8]
    lines = stages["line_dedup"](spark, docs, folder)
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert texts[1] == ROWS[0][1] and texts[2] == "" and texts[6] is None
    assert "shared" in texts[3] and "shared" not in texts[4]
    near = stages["simhash_near_dedup"](spark, docs, folder)
    assert sorted(r.doc_id for r in near.collect()) == [1, 3, 4, 5, 6, 7, 8]
    clean = stages["benchmark_decontamination"](spark, docs, folder)
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 3, 4, 6, 7, 8, 9]
    coded = stages["sentencepiece"](spark, docs, folder).collect()
    assert all(r.text is None or (r.round_trip and r.n_ids == len(r.ids)) for r in coded)
    for stage in (known, lines, near, clean):
        assert stage.columns == docs.columns


def test_empty_table(spark, folder):
    docs = docs_of(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.collect() == []
        docs = docs if "ids" in out.columns else out


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    want = docs.collect()
    assert sorted((r.doc_id, r.text, r.n_ids) for r in got) == sorted((r.doc_id, r.text, r.n_ids) for r in want)
    assert len({r.doc_id for r in got}) == len(got)


def test_line_removal_counts_the_words_of_all_documents(spark, folder, monkeypatch):
    counted = []
    count = line_dedup.word_counts
    monkeypatch.setattr(line_dedup, "word_counts", lambda rows, buckets: counted.append(count(rows, buckets)) or counted[-1])
    docs = docs_of(spark, [(n, f"one two n{n}\nthree", "aa") for n in range(9_000)])
    lines = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, folder)
    assert lines.count() == 9_000
    assert [int(c.sum()) for c in counted] == [4 * 9_000]
