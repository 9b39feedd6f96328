from collections import Counter
import re
import string

import pytest
from pyspark.sql import functions as F

from docquarry.operators import (
    admission,
    answer_f1,
    attempts,
    checks,
    comparison,
    conversation,
    dataset,
    integrity,
    prompts,
    report,
    semantic,
    telemetry,
)
from docquarry.params import AdmissionLimits

KEYS = ["paper_id", "question_id"]


def f1(prediction, reference):
    def words(x):
        x = "".join(c for c in x.lower() if c not in string.punctuation)
        return re.sub(r"\b(a|an|the)\b", " ", x).split()

    p, r = words(prediction), words(reference)
    common = sum((Counter(p) & Counter(r)).values())
    return 0.0 if not common else 2 * (common / len(p)) * (common / len(r)) / (common / len(p) + common / len(r))


PAIRS = [
    ("The cat, the cat sat.", "a cat cat"),
    ("the a an", "..."),
    ("it's", "its"),
    ("x x x y", "x x z"),
    ("nothing", "else"),
    ("the document does not contain THIS information.", "x"),
    ("Éa the théâtre", "éa theatre théâtre"),
]


def test_token_f1(spark):
    cases = spark.createDataFrame(
        [("p", str(i), "success", a) for i, (a, _) in enumerate(PAIRS)] + [("p", "err", "error", "x"), ("p", "blank", "success", " ")],
        "paper_id string, question_id string, status string, prediction string",
    )
    refs = spark.createDataFrame(
        [("p", str(i), 0, b, "extractive") for i, (_, b) in enumerate(PAIRS)]
        + [("p", k, j, "x", t) for k in ("err", "blank") for j, t in enumerate(("boolean", "none"))],
        "paper_id string, question_id string, annotation_index int, answer string, answer_type string",
    )
    scored = answer_f1.score_references(cases, refs, KEYS)
    got = {r["question_id"]: r["f1"] for r in scored.collect()}
    for i, (a, b) in enumerate(PAIRS):
        a = "Unanswerable" if "does not contain" in a else a
        assert got[str(i)] == pytest.approx(f1(a, b), abs=1e-12), (a, b)
    best = {r["question_id"]: r for r in answer_f1.best_reference(scored, KEYS).collect()}
    assert best["err"]["answer_f1"] == 0.0 and best["err"]["matched_answer_type"] == "boolean"
    assert best["blank"]["annotation_index"] == 0
    m = answer_f1.run_metrics(answer_f1.best_reference(scored, KEYS), cases, KEYS).first()
    assert m["evaluated_cases"] == 9 and m["generation_errors"] == 1 and m["f1_none"] == 0.0


def bundle(spark, annotations):
    ddl = (
        "paper_id string, question_id string, gold_answers struct<answer:array<struct<unanswerable:boolean,"
        "extractive_spans:array<string>,yes_no:boolean,free_form_answer:string,evidence:array<string>,"
        "highlighted_evidence:array<string>>>,annotation_id:array<string>,worker_id:array<string>>"
    )
    ids = [f"a{i}" for i in range(len(annotations))]
    return spark.createDataFrame([("p", "q", (annotations, ids, ids))], ddl)


def test_annotations(spark):
    a = [
        (True, ["x"], None, "", [], []),
        (False, ["x", "y"], True, "f", ["e"], [" "]),
        (False, [], True, "f", ["e", " "], ["h"]),
        (False, [], True, "", [], []),
        (False, [], False, "", [], []),
        (False, [], None, "", [], []),
    ]
    got = answer_f1.references(bundle(spark, a), KEYS).orderBy("annotation_index").collect()
    assert [(r["answer"], r["answer_type"]) for r in got] == [
        ("Unanswerable", "none"),
        ("x, y", "extractive"),
        ("f", "abstractive"),
        ("Yes", "boolean"),
        ("No", "boolean"),
        (None, None),
    ]
    assert [(r["evidence"]["source"], r["evidence"]["ordered_values"]) for r in got][:3] == [
        ("none", []),
        ("evidence", ["e"]),
        ("highlighted_evidence", ["h"]),
    ]
    assert [r["rule"] for r in integrity.gold_bundles(bundle(spark, a)).collect()] == ["no_valid_answer"]


@pytest.mark.parametrize(
    "history, answer, judge",
    [
        (["error", "success", "error"], 2, 2),
        (["error", "error"], 2, 2),
        (["success", "success"], 2, 2),
        (["generation_error", "judge_error"], 2, 1),
        (["judge_error", "generation_error", "success", "judge_error"], 3, 3),
    ],
)
def test_deciding_attempt(spark, history, answer, judge):
    df = spark.createDataFrame(
        [("p", "q", i + 1, s) for i, s in enumerate(history)], "paper_id string, question_id string, line_no int, status string"
    ).repartition(3)
    assert attempts.latest(df, KEYS, "line_no").first()["line_no"] == answer
    got = attempts.latest(df, KEYS, "line_no", attempts.JUDGE_TIERS).first()
    assert (got["line_no"], got["first_seen"], got["attempt_count"]) == (judge, 1, len(history))


def test_case_scores(spark, rows):
    cases = spark.createDataFrame(
        [("p", "ok", "success"), ("p", "gen", "error"), ("p", "bad", "success")], "paper_id string, question_id string, generation_status string"
    )
    outputs = spark.createDataFrame(
        [
            ("p", "ok", 0, "a0", "r0", "none", 0.7, "why0", None, None),
            ("p", "ok", 1, "a1", "r1", "boolean", 0.7, "why1", None, None),
            ("p", "gen", 0, "a0", "r0", "none", 1.0, "w", None, None),
            ("p", "bad", 0, "a0", "r0", "none", 0.9, "w", None, None),
            ("p", "bad", 1, "a1", "r1", "none", 1.2, "w", None, None),
            ("p", "bad", 2, "a2", "r2", "none", None, None, "E", "down"),
        ],
        "paper_id string, question_id string, reference_index int, annotation_id string, reference_answer string, answer_type string, "
        "score double, reason string, error_type string, error_message string",
    )
    got = semantic.resolve_cases(cases, semantic.reference_results(outputs, 0.7), KEYS, 0.7)
    assert rows(got, "question_id", "status", "semantic_score", "passed", "matched_reference_index", "error_message") == [
        ("bad", "judge_error", None, None, None, "DeepEval returned out-of-range score 1.2."),
        ("gen", "generation_error", 0.0, False, None, None),
        ("ok", "success", 0.7, True, 0, None),
    ]
    m = semantic.run_metrics(cases, got, KEYS).first()
    assert m["evaluation_coverage"] == pytest.approx(2 / 3) and m["mean_semantic_correctness"] == 0.35
    assert m["full_run_semantic_correctness"] is None and m["pass_rate"] == 0.5
    empty = semantic.run_metrics(cases.limit(0), got, KEYS).first()
    assert empty["evaluation_coverage"] == 0.0 and empty["mean_semantic_correctness"] is None


def test_bands(spark, rows):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.11, 0.4, 0.6, 0.61, 0.8, 0.81, 1.0, None)], "semantic_score double")
    assert rows(semantic.band_counts(df)) == [("0-1", 2), ("2-4", 2), ("5-6", 1), ("7-8", 2), ("9-10", 2)]


def test_snapshot_deltas(spark, rows):
    df = spark.createDataFrame([("j", 1, 2), ("j", 2, 5), ("j", 3, 5), ("k", 1, 1)], "j string, n long, c long")
    assert rows(semantic.snapshot_deltas(df, ["j"], "n", ["c"])) == [("j", 1, 2), ("j", 2, 3), ("j", 3, 0), ("k", 1, 1)]


def test_relevance_outputs(spark):
    good = '{"scores":[2,0,1],"label":"high","explanation":" yes "}'
    data = [
        (0, "stop", 1, None, good),
        (3, "stop", 1, None, good),
        (3, "stop", 1, None, good.replace("[2,0,1]", "[2,true,1]")),
        (3, "stop", 1, None, good.replace("[2,0,1]", "[2,0]")),
        (3, "stop", 1, None, good.replace("high", "odd")),
        (3, "stop", 1, None, good.replace(" yes ", " ")),
        (3, "length", 1, None, good),
        (3, "stop", 2, None, good),
        (3, "stop", 1, None, "{"),
        (3, "stop", 1, None, "[]"),
        (3, "stop", 1, "boom\n x", None),
        (7, "stop", 1, None, good.replace("[2,0,1]", "[2,2,2,2,2,0,0]")),
    ]
    df = spark.createDataFrame(data, "doc_count int, finish_reason string, choice_count int, request_error string, content string").withColumn("latency", F.lit(1.0))
    got = [(r["relevance_label"], r["relevance_score"], r["relevance_explanation"]) for r in checks.relevance(df).collect()]
    say = checks.RELEVANCE
    assert got[0] == ("low", 0.0, checks.NO_CONTEXT)
    assert got[1][0] == "high" and got[1][1] == pytest.approx((1.0 + 0.3) / 2.4) and got[1][2] == "yes"
    assert [g[2] for g in got[2:8]] == [say.scores, say.scores, say.label, say.explanation, say.budget, say.choice_count]
    assert got[8][2].startswith(say.unparsed) and got[9][2].startswith(say.failed)
    assert got[10][2] == say.failed + "boom x"
    assert got[11][1] == 1.0
    assert all(g[0] == "unknown" and g[1] is None for g in got[2:11])


def test_suffix_is_added_and_removed(spark):
    df = spark.createDataFrame(
        [("high", "grounded", "multi", "all"), ("odd", "odd", "multi", "some"), ("unknown", "not_grounded", "single", "all")],
        "r string, g string, k string, s string",
    ).withColumn("n", F.array(F.lit("a"), F.lit("b")))
    tail = conversation.diagnostics_suffix(*[F.col(c) for c in "rgksn"])
    got = [r[0] for r in df.select(tail).collect()]
    assert got[0].endswith("Scope:** All indexed documents (2)") and got[1].endswith("Selected documents (a, b)")
    assert "Low\n" in got[1] and got[1].count("Partially grounded") == 1 and "Scope" not in got[2]
    texts = [f"Answer.{t}" for t in got] + ["Answer.\n\nRetrieval relevance: 🟡 Medium\r\nGroundedness: Grounded \n"]
    keep = ["Retrieval relevance: High", texts[0] + " more"]
    clean = spark.createDataFrame([(t,) for t in texts + keep], "x string").select(conversation.without_suffix(F.col("x")))
    assert [r[0] for r in clean.collect()] == ["Answer."] * 4 + keep


def test_prompt_and_context(spark):
    sources = spark.createDataFrame([(1, 2, "two"), (1, 1, "one {history}")], "query_id long, rank int, passage string")
    q = spark.createDataFrame([(1, "why"), (2, "how")], "query_id long, question string")
    got = {r["query_id"]: r["prompt"] for r in prompts.prompts(q, prompts.contexts(sources, numbered=True), template="{history}|{context}|{question}").collect()}
    assert got == {1: "|[Context 1]\none {history}\n\n[Context 2]\ntwo|why", 2: "||how"}


def test_admission(spark):
    asked = [("s", i, "ok") for i in range(7)] + [("s", 10, " "), ("s", 3.5, "x" * 2001), ("t", 1, "y" * 2000 + "  ")]
    df = spark.createDataFrame([(a, float(b), c) for a, b, c in asked], "session_id string, ts double, question string")
    got = {(r["session_id"], r["ts"]): r["admission"] for r in admission.admit_questions(df, ["ts"]).collect()}
    assert [got[("s", float(i))] for i in range(7)] == ["admitted"] * 5 + ["over_limit"] * 2
    assert got[("s", 10.0)] == "noop" and got[("s", 3.5)] == "too_long" and got[("t", 1.0)] == "admitted"
    used = spark.createDataFrame([("s", 4), ("t", 5)], "session_id string, used int")
    later = {(r["session_id"], r["ts"]): r["admission"] for r in admission.admit_questions(df, ["ts"], AdmissionLimits(), used).collect()}
    assert [later[("s", float(i))] for i in range(3)] == ["admitted", "over_limit", "over_limit"]
    assert later[("t", 1.0)] == "over_limit"


MIB = 1024 * 1024


@pytest.mark.parametrize(
    "files, held, mode, want",
    [
        ([("a.pdf", 10 * MIB, "1")], [], "multi", None),
        ([("a.pdf", 10 * MIB + 1, "1")], [], "multi", admission.FILE_TOO_LARGE),
        ([("a.txt", 1, "1")], [], "multi", admission.WRONG_TYPE),
        ([("a.pdf", 1, "1")], [("8", 1), ("9", 1)], "multi", None),
        ([("a.pdf", 1, "1"), ("b.pdf", 1, "2")], [("8", 1), ("9", 1)], "multi", admission.TOO_MANY_DOCUMENTS),
        ([("a.pdf", 10 * MIB, "1"), ("b.pdf", 10 * MIB, "2")], [], "multi", None),
        ([("a.pdf", 10 * MIB, "1")], [("8", 10 * MIB + 1)], "multi", admission.TOO_MANY_BYTES),
        ([("a.pdf", 1, "1"), ("b.pdf", 1, "1"), ("c.pdf", 1, "9")], [("8", 1), ("9", 1)], "multi", None),
        ([("a.pdf", 1, "1"), ("b.pdf", 1, "2")], [("7", 1), ("8", 1), ("9", 1)], "single", None),
    ],
)
def test_upload_budget(spark, files, held, mode, want):
    f = spark.createDataFrame([("k", i, *x, 700, 100) for i, x in enumerate(files)], "kb_id string, pos int, path string, size_bytes long, fingerprint string, chunk_size int, chunk_overlap int")
    h = spark.createDataFrame([("k", p, b, p, 700, 100) for p, b in held], "kb_id string, doc_id string, size_bytes long, fingerprint string, chunk_size int, chunk_overlap int")
    b = spark.createDataFrame([("k", mode, mode)], "kb_id string, mode string, current_mode string")
    none = spark.createDataFrame([], "kb_id string, fingerprint string")
    assert admission.check_uploads(f, h, b, none).first()["rejection"] == want


def test_comparison(spark, rows):
    data = [("p", "1", "A", "high"), ("p", "1", "B", "high"), ("p", "2", "A", "high"), ("p", "2", "B", "low"), ("p", "3", "A", "odd"), ("p", "3", "B", "low"), ("p", "4", "A", "low")]
    df = spark.createDataFrame(data, "paper_id string, question_id string, model_id string, l string")
    pairs = comparison.paired(df, KEYS, ("A", "B"), "l", checks.RELEVANCE_LABELS)
    assert tuple(comparison.agreement(pairs).first()) == (2, 1, 0.5)
    assert rows(comparison.disagreement_cases(pairs, pairs, keys=KEYS)) == [("p", "2")]
    none = comparison.agreement(pairs.limit(0)).first()
    assert none["agreement_rate"] is None
    dist = {(r["model_id"], r["label"]): r["n"] for r in comparison.label_distribution(df, "l", checks.RELEVANCE_LABELS, 4, ("A", "B", "C")).collect()}
    assert dist[("A", "unknown")] == 1 and dist[("B", "missing")] == 1 and dist[("A", "missing")] == 0
    assert dist[("C", "missing")] == 4 and dist[("C", "high")] == 0
    timed = df.select("*", *[F.lit(None).cast("double").alias(f"{p}_latency") for p in ("relevance", "groundedness")])
    assert rows(comparison.latency_summaries(timed, ("C",)), "model_id", "part", "n", "median") == sorted(
        [("C", p, 0, None) for p in comparison.LATENCY_PARTS], key=repr
    )


def test_triage_and_readiness(spark):
    answers = spark.createDataFrame([("p", "1", 0, "success"), ("p", "2", 1, "error"), ("p", "3", 2, "success")], "paper_id string, question_id string, case_ordinal long, status string")
    judged = spark.createDataFrame([("p", "1", "success", True), ("p", "2", "generation_error", False)], "paper_id string, question_id string, judge_status string, passed boolean")
    labels = spark.createDataFrame([("p", "1", "high", "grounded"), ("p", "2", "missing", "missing"), ("p", "3", "unknown", "not_grounded")], "paper_id string, question_id string, relevance string, groundedness string")
    t = report.triage(answers, judged, labels, KEYS)
    got = [(r["question_id"], r["severity"], r["issues"]) for r in report.attention(t).collect()]
    assert got == [("2", 0, ["generation error", "failed semantic threshold"]), ("3", 3, ["not grounded", "unknown relevance"])]
    columns = "is_subset boolean, selected long, succeeded long, f1_available boolean, semantic_selected long, semantic_coverage double, judge_errors long, log_matched long, log_duplicates long, unknown_labels long, missing_labels long"
    full = (False, 3, 3, True, 3, 1.0, 0, 3, 0, 0, 0)
    cases = {full: "ready", (*full[:9], 1, 0): "ready_with_diagnostic_warning", (True, *full[1:]): "not_ready", (*full[:4], None, None, None, *full[7:]): "not_ready", (*full[:8], 1, 0, 0): "not_ready"}
    got = report.readiness(spark.createDataFrame(list(cases), columns)).collect()
    assert [r["readiness"] for r in got] == list(cases.values())


def test_diagnostic_label(spark):
    values = ["High", "retrieval-low", " partially grounded ", "not-grounded", "grounded", "ungrounded", None, ""]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [r[0] for r in df.select(report.diagnostic_label(F.col("x"), checks.GROUNDEDNESS_LABELS)).collect()]
    assert got == ["unknown", "unknown", "partially_grounded", "not_grounded", "grounded", "unknown", "unknown", "unknown"]


def test_cases_in_dataset_order(spark, rows):
    cases = spark.createDataFrame([(p, f"q{i}", n, i + 10 * n) for n, p in enumerate("ab") for i in range(3)], "paper_id string, question_id string, paper_ordinal int, case_ordinal long")
    assert rows(dataset.first_cases(cases, 1, 2), "paper_id", "question_id") == [("a", "q0"), ("a", "q1")]
    assert dataset.first_cases(cases, None, 4).count() == 4
    done = spark.createDataFrame([("a", "q0", "error"), ("a", "q1", "success")], "paper_id string, question_id string, status string")
    assert ("a", "q1") not in rows(dataset.pending(cases, done), "paper_id", "question_id")
    import hashlib
    import json

    def blocks(keys, size):
        digests = [
            hashlib.sha256(json.dumps(keys[i : i + size], separators=(",", ":")).encode()).hexdigest()
            for i in range(0, len(keys), size)
        ]
        return len(keys), hashlib.sha256(json.dumps(digests, separators=(",", ":")).encode()).hexdigest()

    keys = [f"{p}/q{i}" for p in "ab" for i in range(3)]
    for size in (4, 6, 7):
        assert tuple(dataset.ordered_key_digest(cases, block=size).first()) == blocks(keys, size)
    assert tuple(dataset.ordered_key_digest(cases.limit(0)).first()) == blocks([], 1)
    for n in (10_000, 10_001):
        many = spark.range(n).selectExpr("'p' AS paper_id", "concat('q', id) AS question_id", "id AS case_ordinal")
        assert tuple(dataset.ordered_key_digest(many).first()) == blocks([f"p/q{i}" for i in range(n)], 10_000)


def test_a_case_without_reference_results_is_a_judge_error(spark):
    cases = spark.createDataFrame([("c", "success"), ("d", "error")], "case_id string, generation_status string")
    none = spark.createDataFrame(
        [],
        "case_id string, reference_index int, annotation_id string, reference_answer string, answer_type string,"
        " status string, semantic_score double, judge_reason string, error_type string, error_message string",
    )
    got = {r["case_id"]: r for r in semantic.resolve_cases(cases, none, ["case_id"], 0.5).collect()}
    assert got["c"]["status"] == "judge_error" and got["c"]["error_message"] == semantic.NO_REFERENCE_RESULTS
    assert got["d"]["status"] == "generation_error" and got["d"]["semantic_score"] == 0.0


def test_request_record(spark):
    chunks = spark.createDataFrame([("c", "d", "f.docx", 2, "docx", "section", "S", " body ")], "chunk_id string, doc_id string, source_name string, page int, file_type string, doc_type string, section_header string, text string")
    final = spark.createDataFrame([(1, 1, "c", 0.25, 0.7, 0.8)], "query_id int, rank int, chunk_id string, distance double, fusion_score double, rerank_score double")
    request = dict(
        timestamp="t", conversation_id="cv", query_id=1, kb_mode="single", active_doc_names=["f.docx"], original_query="q", rewritten_query="r",
        retrieval_route="balanced", fusion_alpha=0.65, retrieval_top_n=10, rerank_candidate_n=5, rerank_top_k=3, fusion_threshold=0.1,
        retrieval_relevance="high", relevance_score=0.9, relevance_explanation="re", retrieval_eval_latency=0.2, groundedness_label="grounded",
        groundedness_explanation="ge", groundedness_eval_latency=0.3, answer="an", retrieval_latency=1.0, dense_latency=0.4, bm25_latency=0.1,
        fusion_latency=0.2, rerank_latency=0.3, total_tokens=123, llm_latency=2.0,
    )
    margins = spark.createDataFrame([(1, None)], "query_id int, rerank_margin double")
    got = telemetry.request_records(
        spark.createDataFrame([request]),
        telemetry.source_rows(final.drop("rerank_score"), chunks, 300),
        telemetry.source_rows(final, chunks, 500),
        margins,
    ).first().asDict(recursive=True)
    source = dict(rank=1, doc_id="d", file_name="f.docx", chunk_id="c", page=2, distance=0.25, similarity=0.8, fusion_score=0.7, content_preview="body", file_type="docx", doc_type="section", section_header="S")
    r = got["retrieval"]
    assert r["raw_retrieval"] == [source] and r["final_sources"] == [{**source, "rerank_score": 0.8}]
    assert (r["num_fusion_survivors"], r["num_reranker_candidates"], r["num_final_sources"], r["rerank_margin"]) == (1, 1, 1, None)
    assert r["latency"] == dict(total_seconds=1.0, dense_seconds=0.4, bm25_seconds=0.1, fusion_seconds=0.2, rerank_seconds=0.3)
    assert got["llm_metrics"] == dict(total_tokens=123, latency_seconds=2.0) and got["generation"]["answer"] == "an"


def test_availability_of_nothing_is_zero(spark):
    logs = spark.createDataFrame(
        [], "retrieval struct<retrieval_relevance:string,relevance_explanation:string>, generation struct<groundedness_label:string,groundedness_explanation:string>"
    )
    got = telemetry.availability(logs).collect()
    assert len(got) == 16 and all(r["n"] == 0 for r in got)
