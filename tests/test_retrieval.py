import math
import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from docquarry.operators import dense, fusion, index, lexical, modelstage, rerank, routing, scope
from docquarry.params import RetrievalParams


def bm25(corpus, query):
    docs = [Counter(d.split()) for d in corpus]
    lengths = [sum(d.values()) for d in docs]
    n, avg = len(docs), sum(lengths) / len(docs)
    df = Counter(t for d in docs for t in d)
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    return [
        sum(idf.get(t, 0) * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * length / avg)) for t in query.split())
        for d, length in zip(docs, lengths)
    ]


def expected_top(corpus, query, n, allowed=None):
    scores = [(round(s, 10), i) for i, s in enumerate(bm25(corpus, query)) if allowed is None or i in allowed]
    top = sorted(scores, key=lambda x: (-x[0], x[1]))[:n]
    if not top:
        return []
    lo, hi = min(s for s, _ in top), max(s for s, _ in top)
    return [(i, round(1.0 if hi == lo else (s - lo) / (hi - lo), 6)) for s, i in top]


CORPORA = {
    "ordinary": ["a b c", "a b", "d e f g", "a a a h", "x y", "d d", "h i j k l", "z"],
    "shared term": ["s a", "s b", "s c", "s d", "s"],
    "copies": ["s s", "s s", "s s"],
    "single": ["only one"],
    "mean weight below zero": ["a b", "a b", "a b c", "a", "b a"],
}
QUERIES = ["a", "a a b", "s", "nothing here", "d zz h", "only", "b c"]


def frames(spark, corpus, queries):
    chunks = spark.createDataFrame(
        [("k", f"d{i}", f"c{i}", i, t) for i, t in enumerate(corpus)],
        "kb_id string, doc_id string, chunk_id string, ordinal long, text string",
    )
    asked = spark.createDataFrame(
        [("k", i, q) for i, q in enumerate(queries)], "kb_id string, query_id long, question string"
    )
    return chunks, asked


@pytest.mark.parametrize("name", CORPORA)
@pytest.mark.parametrize("shipped", [True, False])
def test_lexical_top_n(spark, monkeypatch, name, shipped):
    if not shipped:
        monkeypatch.setattr(lexical, "is_shippable", lambda *a, **k: False)
    corpus = CORPORA[name]
    chunks, asked = frames(spark, corpus, QUERIES)
    lex = index.build_lexical_index(chunks)
    got = lexical.top_chunks(asked, lex, 4).collect()
    for q, query in enumerate(QUERIES):
        mine = sorted((r["rank"], r["ordinal"], round(r["bm25"], 6)) for r in got if r["query_id"] == q)
        assert [(o, s) for _, o, s in mine] == expected_top(corpus, query, 4), (name, query)


def test_scope_is_applied_before_the_top_n(spark):
    corpus = CORPORA["ordinary"]
    chunks, asked = frames(spark, corpus, QUERIES)
    allowed = {1, 3, 5, 7}
    scoped = asked.crossJoin(spark.createDataFrame([(f"d{i}",) for i in allowed], "doc_id string"))
    got = lexical.top_chunks(asked, index.build_lexical_index(chunks), 3, scope=scoped).collect()
    for q, query in enumerate(QUERIES):
        mine = sorted((r["rank"], r["ordinal"], round(r["bm25"], 6)) for r in got if r["query_id"] == q)
        assert [(o, s) for _, o, s in mine] == expected_top(corpus, query, 3, allowed)


def test_postings_are_not_shuffled_for_scoring(spark):
    chunks, asked = frames(spark, CORPORA["ordinary"], QUERIES)
    plan = lexical.score(asked, index.build_lexical_index(chunks))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" in plan
    assert not any("hashpartitioning(chunk_id" in x and "query_id" in x for x in plan.splitlines())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_cut_before_rows_move(spark):
    chunks, asked = frames(spark, CORPORA["ordinary"], QUERIES)
    top = lexical.top_chunks(asked, index.build_lexical_index(chunks), 3)
    assert "WindowGroupLimit" in plan_of(top)


def test_texts_are_not_moved_for_reranking(spark):
    fused = spark.range(3).select(F.col("id").alias("query_id"), F.lit("c").alias("chunk_id"), F.lit(1).alias("fusion_rank"))
    asked = spark.range(3).select(F.col("id").alias("query_id"), F.lit("q").alias("question"))
    passages = spark.range(10**9).select(F.col("id").cast("string").alias("chunk_id"), F.lit("p").alias("passage"))
    got = plan_of(rerank.rerank(fused, asked, passages, 2, per_question=5))
    assert "SortMergeJoin" not in got.split("range")[0] or "BroadcastHashJoin [chunk_id" in got
    assert not any("hashpartitioning(chunk_id" in x for x in got.splitlines())


def test_lookup_drops_unknown_lexical_chunks_only(spark):
    d = spark.createDataFrame([(1, "x", 0.2, 1.0)], "query_id long, chunk_id string, distance double, dense double")
    b = spark.createDataFrame([(1, "x", 1.0), (1, "y", 1.0)], "query_id long, chunk_id string, bm25 double")
    q = spark.createDataFrame([(1, 0.5)], "query_id long, alpha double")
    none = spark.createDataFrame([], "chunk_id string")
    got = fusion.fuse(d, b, q, lookup=none, per_question=5).collect()
    assert [(r["chunk_id"], r["fusion_score"]) for r in got] == [("x", 1.0)]


def vectors(spark, n=60, width=8):
    rnd = random.Random(3)
    data = []
    for i in range(n):
        v = [rnd.gauss(0, 1) for _ in range(width)]
        size = math.sqrt(sum(x * x for x in v))
        data.append(("k" if i % 5 else "other", f"d{i % 7}", f"c{i:03d}", i, [x / size for x in v]))
    data.append(("k", "d1", "c100", 100, data[1][4]))
    return data, spark.createDataFrame(
        data, "kb_id string, doc_id string, chunk_id string, ordinal long, embedding array<float>"
    ).repartition(4)


@pytest.mark.parametrize("shipped", [True, False])
def test_dense_top_n(spark, monkeypatch, shipped):
    monkeypatch.setattr(dense, "GRID_BLOCK_ROWS", 7)
    data, table = vectors(spark)
    asked = table.filter("ordinal < 20").select("kb_id", F.col("ordinal").alias("query_id"), "embedding")
    found = dense.nearest(asked, table, 5, max_shipped_values=10**6 if shipped else 1)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"]))
    for kb, _, _, q, v in data[:20]:
        near = sorted(
            (round(sum((a - b) ** 2 for a, b in zip(v, w)), 6), o, c) for k2, _, c, o, w in data if k2 == kb
        )[:5]
        assert [c for _, c in sorted(got[q])] == [c for _, _, c in near]


def test_scope_shortens_the_dense_list_and_scores_are_normalised(spark):
    _, table = vectors(spark)
    asked = table.filter("ordinal < 5").select("kb_id", F.col("ordinal").alias("query_id"), "embedding")
    found = dense.nearest(asked, table, 6)
    scoped = asked.select("query_id").crossJoin(spark.createDataFrame([("d1",), ("d2",)], "doc_id string"))
    got = dense.with_dense_score(dense.scoped(found, table, scoped, asked, 6)).collect()
    assert 0 < len(got) < 30
    assert all(0.0 <= r["dense"] <= 1.0 for r in got)


def test_fusion(spark):
    d = spark.createDataFrame([(1, "a", 0.2, 1.0), (1, "b", 0.4, 0.0)], "query_id long, chunk_id string, distance double, dense double")
    b = spark.createDataFrame([(1, "b", 1.0), (1, "c", 1.0), (1, "gone", 0.5)], "query_id long, chunk_id string, bm25 double")
    q = spark.createDataFrame([(1, 0.5)], "query_id long, alpha double")
    known = spark.createDataFrame([("a",), ("c",)], "chunk_id string")
    every = fusion.fuse(d, b, q, lookup=known).orderBy("fusion_rank").collect()
    assert [(r["chunk_id"], r["fusion_score"], r["distance"]) for r in every] == [
        ("a", 0.5, 0.2),
        ("b", 0.5, 0.4),
        ("c", 0.5, 1.0),
    ]
    assert fusion.fuse(d, b, q, threshold=0.5).count() == 3
    assert fusion.fuse(d, b, q, threshold=0.51).count() == 0
    assert fusion.candidates(fusion.fuse(d, b, q), 2).count() == 2


ROUTES = [
    ("what is it", "auto", "balanced"),
    ("What are the main ideas of this work", "auto", "semantic"),
    ("what", "auto", "balanced"),
    ("whatever they say about the main topic", "auto", "balanced"),
    ("GPU cost", "auto", "keyword"),
    ("tell me about 3 of the \"main\" ideas", "auto", "balanced"),
    ("the authors' 2 ideas about many things", "auto", "keyword"),
    ("Explain how GPT4 works in all detail", "auto", "balanced"),
    ("long question about nothing in particular", "auto", "balanced"),
    ("x", " KEYWORD ", "keyword"),
    ("x 1", "unheard", "keyword"),
    ("the É1 model and its many many parts", "auto", "keyword"),
    ("A is a letter in this long text", "auto", "balanced"),
]


def python_route(q, mode):
    mode = (mode or "auto").strip().lower()
    if mode in ("keyword", "semantic", "balanced"):
        return mode
    q = q.strip()
    words = q.split()
    signals = [
        len(words) <= 4,
        any(c.isdigit() for c in q),
        any(t.isupper() and len(t) >= 2 for t in words),
        '"' in q or "'" in q,
    ]
    semantic = any(q.lower() == w or q.lower().startswith(w + " ") for w in routing.SEMANTIC_STARTERS)
    if sum(signals) >= 2 and not semantic:
        return "keyword"
    return "semantic" if semantic and not any(signals) else "balanced"


def test_routes(spark):
    df = spark.createDataFrame([(q, m) for q, m, _ in ROUTES], "q string, m string")
    got = [r[0] for r in df.select(routing.route(F.col("q"), F.col("m"))).collect()]
    assert got == [python_route(q, m) for q, m, _ in ROUTES]
    assert got == [w for _, _, w in ROUTES]


def test_rerank_keeps_fusion_order_on_ties(spark):
    c = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id long, chunk_id string, fusion_rank int")
    q = spark.createDataFrame([(1, "x y")], "query_id long, question string")
    p = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y x")], "chunk_id string, passage string")
    got = rerank.rerank(c, q, p, 2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["c", "a"]
    assert rerank.margin(rerank.rerank(c, q, p, 3)).first()["rerank_margin"] == 0.5

    def make():
        return lambda questions, passages: passages.str.len() * -1.0

    by_model = rerank.rerank(c, q, p, 3, rerank.model_score(make)).orderBy("rank").collect()
    assert [r["chunk_id"] for r in by_model] == ["a", "b", "c"]


def test_scope_of_repeated_names(spark, rows):
    docs = spark.createDataFrame([("k", "d1", "f", 1), ("k", "d2", "f", 2), ("k", "d3", "g", 3)], "kb_id string, doc_id string, file_name string, n long")
    asked = spark.createDataFrame(
        [(1, "k", "all", None), (2, "k", "selected", ["f"]), (3, "k", "selected", []), (4, "k", "odd", ["g"])],
        "query_id long, kb_id string, scope_mode string, selected array<string>",
    )
    got = scope.active_documents(asked, docs, "n")
    assert rows(got, "query_id", "doc_id") == [(1, "d1"), (1, "d2"), (1, "d3"), (2, "d2"), (4, "d1"), (4, "d2"), (4, "d3")]


def test_scopes_allow_the_same_documents_as_their_pairs(spark, rows):
    docs = spark.createDataFrame(
        [("k", f"d{n}", f"f{n % 4}", n) for n in range(12)] + [("l", "e1", "f1", 1)], "kb_id string, doc_id string, file_name string, n long"
    )
    asked = spark.createDataFrame(
        [(1, "k", "all", None), (2, "k", "selected", ["f1", "f2", "f1"]), (3, "k", "selected", []), (4, "k", "odd", ["f1"]), (5, "k", "selected", ["f2", "f1"]), (6, "l", "selected", ["f1"]), (7, "k", "selected", None)],
        "query_id long, kb_id string, scope_mode string, selected array<string>",
    )
    found = asked.select("query_id", "kb_id").join(docs.select("kb_id", "doc_id"), "kb_id").withColumn("score", F.lit(1))
    pairs = scope.active_documents(asked, docs, "n")
    narrowed = scope.of_requests(asked, docs, "n")
    # Two questions with one selection share its documents; those without a list are not written out.
    assert narrowed.members.count() == 3
    want = rows(pairs, "query_id", "doc_id")
    assert rows(narrowed.allowed(found), "query_id", "doc_id") == want == rows(scope.as_scope(pairs).allowed(found), "query_id", "doc_id")
    chunks = docs.select("kb_id", "doc_id", F.concat("doc_id", F.lit("c")).alias("chunk_id"), F.col("n").alias("ordinal"), F.lit("w1 w2").alias("text"))
    questions = asked.select("kb_id", "query_id", F.lit("w9 w1").alias("question"))
    lex = index.build_lexical_index(chunks)
    for n in (1, 2, 50):
        by_scope, by_pairs = (lexical.top_chunks(questions, lex, n, scope=s) for s in (narrowed, pairs))
        assert rows(by_scope, "query_id", "chunk_id", "rank") == rows(by_pairs, "query_id", "chunk_id", "rank")
    groups = scope.by_group(
        spark.createDataFrame([(1, "x"), (2, None)], "query_id long, group string"),
        spark.createDataFrame([("d1", "x"), ("d2", "y"), ("d3", None)], "doc_id string, group string"),
    )
    assert rows(groups.allowed(found), "query_id", "doc_id") == [(1, "d1")]


def test_a_shared_retrieval_runs_once(spark, rows):
    from docquarry.plans import hybrid

    words = ["alpha", "beta", "gamma", "delta"]
    chunks = spark.createDataFrame(
        [("k", f"d{n}", f"c{n}", n, " ".join(words[: n % 4 + 1]), "p " + words[n % 4]) for n in range(12)],
        "kb_id string, doc_id string, chunk_id string, ordinal long, text string, passage string",
    )
    vectors = chunks.select("kb_id", "doc_id", "chunk_id", "ordinal", F.array(F.col("ordinal") / 3, F.lit(1.0)).alias("embedding"))
    asked = spark.createDataFrame([("k", 1, "alpha beta", [0.0, 1.0]), ("k", 2, "delta", [3.0, 1.0])], "kb_id string, query_id long, question string, embedding array<double>")
    params = RetrievalParams(top_n=5, rerank_candidates=4, rerank_top_k=3)
    once, planned = (hybrid.retrieve(asked, chunks, vectors, params, share=s) for s in (True, False))
    for part in ("fused", "final"):
        assert rows(getattr(once, part), "query_id", "chunk_id") == rows(getattr(planned, part), "query_id", "chunk_id")
    assert once.totals == {
        "survivors": planned.fused.count(),
        "candidates": planned.fused.filter("fusion_rank <= 4").count(),
        "final_sources": planned.final.count(),
    }
    counts = fusion.stage_counts(once.questions, once.fused, once.final, 4)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "MapInArrow" not in plan


def test_clamps():
    p = RetrievalParams(top_n=0, rerank_candidates=2, rerank_top_k=-1, fusion_threshold=3.0).clamped()
    assert (p.top_n, p.rerank_candidates, p.rerank_top_k, p.fusion_threshold) == (1, 2, 1, 1.0)


def test_index_round_trip(spark, tmp_path, rows):
    chunks, _ = frames(spark, CORPORA["ordinary"], QUERIES)
    lex = index.build_lexical_index(chunks)
    index.write_lexical_index(lex, str(tmp_path))
    again = index.read_lexical_index(spark, str(tmp_path))
    assert rows(again.terms, "term", "df") == rows(lex.terms, "term", "df")
    assert again.postings.count() == lex.postings.count()


def test_embedder_is_normalised(spark):
    df = spark.createDataFrame([("a b c",), ("a b c",)], "text string")
    got = [r[0] for r in index.embed_texts(df).select("embedding").collect()]
    assert got[0] == got[1] and sum(x * x for x in got[0]) == pytest.approx(1.0)


def test_a_text_without_words_and_no_text(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "id long, text string").coalesce(1)
    got = {r["id"]: r["embedding"] for r in index.embed_texts(df).collect()}
    assert got[1] is None and got[2] == [0.0] * 64 and sum(x * x for x in got[3]) == pytest.approx(1.0)
    only_null = index.embed_texts(df.filter("id = 1")).first()
    assert only_null["embedding"] is None


def test_a_failing_row_does_not_fail_its_batch(spark):
    import pandas as pd

    def make():
        def model(batch):
            if (batch["p"] == "bad").any():
                raise RuntimeError("no")
            return pd.DataFrame({"text": batch["p"].str.upper(), "choice_count": 1})

        return model

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id long, p string").coalesce(1)
    got = {r["id"]: (r["text"], r["status"], r["error"]) for r in modelstage.run_model(df, make, ["id"]).collect()}
    assert got[1][:2] == ("A", "success") and got[3][:2] == ("C", "success")
    assert got[2] == (None, "error", "RuntimeError: no")


def test_rows_without_a_vector_take_no_part(spark):
    kind = "kb_id string, query_id long, embedding array<double>"
    asked = spark.createDataFrame([("k", 1, None), ("k", 2, [1.0, 0.0])], kind)
    rows = [("k", "a", 0, None), ("k", "b", 1, [0.0, 1.0]), ("k", "c", 2, [1.0, 0.5])]
    vectors = spark.createDataFrame(rows, "kb_id string, chunk_id string, ordinal long, embedding array<double>")
    for bound in (1, 4_000_000):
        got = dense.nearest(asked, vectors, 5, max_shipped_values=bound).collect()
        assert [(r["query_id"], r["chunk_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(2, "c"), (2, "b")]


def test_lexical_search_in_place_equals_search_by_postings(spark, rows):
    random.seed(11)
    words = [f"w{i}" for i in range(30)]
    chunks = spark.createDataFrame(
        [(f"k{i % 2}", f"d{i}", f"c{i}", i, " ".join(random.choice(words) for _ in range(random.randint(0, 12)))) for i in range(60)]
        + [("k0", "none", "cn", 99, None)],
        "kb_id string, doc_id string, chunk_id string, ordinal long, text string",
    )
    asked = spark.createDataFrame(
        [(f"k{i % 2}", i, " ".join(random.choice(words) for _ in range(4))) for i in range(9)] + [("k9", 90, "w1")],
        "kb_id string, query_id long, question string",
    )
    lex = index.build_lexical_index(chunks)
    moved = index.LexicalIndex(lex.chunks, lex.postings, lex.terms, lex.stats)
    columns = ["query_id", "chunk_id", "rank"]
    assert rows(lexical.top_chunks(asked, lex, 6), *columns) == rows(lexical.top_chunks(asked, moved, 6), *columns)
    plan = lexical.top_chunks(asked, lex, 6)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "text" in line]


def test_a_search_keeps_the_chosen_cells_only(monkeypatch):
    """Blocks of the distance matrix go before the next one; ties keep the smaller ordinal, NaN is last."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    rnd = np.random.default_rng(5)
    data = np.round(rnd.normal(size=(2_000, 4)), 1)
    data[7] = np.nan
    rows = pd.DataFrame({"chunk_id": [str(i) for i in range(2_000)], "ordinal": range(2_000), "embedding": list(data)})
    monkeypatch.setattr(dense, "_MATRIX_CELLS", 20_000)
    asked = np.concatenate([data[:40], data[7:8]])
    tracemalloc.start()
    distance, ordinal, _ = dense._nearest(np.repeat(asked, 50, axis=0), rows.sample(frac=1.0, random_state=1), 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All blocks together have 4.1 million cells of 8 bytes.
    assert peak < 8e6
    for q in range(40):
        if q != 7:
            want = sorted((round(float(((data[q] - v) ** 2).sum()), 8), i) for i, v in enumerate(data) if i != 7)[:6]
            assert [i for _, i in want] == ordinal[50 * q].tolist()
    assert ordinal[-1].tolist() == [0, 1, 2, 3, 4, 5] and np.isnan(distance[-1]).all()


def test_a_scoped_search_reads_texts_and_no_postings(spark, rows):
    words = [f"w{n}" for n in range(30)]
    kind = "kb_id string, doc_id string, chunk_id string, ordinal long, text string"
    texts = [("a" if n % 4 else "b", f"d{n}", f"d{n}", n, " ".join(words[(n * k) % 30] for k in range(1, 9)) if n % 7 else None) for n in range(80)]
    lex = index.build_lexical_index(spark.createDataFrame(texts, kind))
    asked = [("a" if q % 4 else "b", q, " ".join(words[(q * k + 3) % 30] for k in range(4))) for q in range(12)]
    questions = spark.createDataFrame(asked, "kb_id string, query_id long, question string")
    # Questions 0 and 4 have their whole base, 5 an empty scope, 6 is not listed.
    named = [(q, None if q in (0, 4) else "none" if q == 5 else f"s{q % 3}") for q in range(12) if q != 6]
    members = [(f"s{s}", f"d{n}") for s in range(3) for n in range(80) if n % 3 == s]
    narrow = scope.Scope(
        spark.createDataFrame(named, "query_id long, scope_id string"),
        spark.createDataFrame(members, "scope_id string, doc_id string"),
    )
    columns = ["query_id", "rank", "chunk_id", "score", "bm25"]
    by_text = lexical.top_chunks(questions, replace(lex, postings=None), 6, scope=narrow)
    by_postings = lexical.top_chunks(questions, replace(lex, texts=None), 6, scope=narrow)
    found = rows(by_text, *columns)
    assert found == rows(by_postings, *columns) and {r[0] for r in found} == set(range(12)) - {5, 6}


def test_weights_of_asked_terms_take_one_pass_over_the_vocabulary(spark):
    kind = "kb_id string, doc_id string, chunk_id string, ordinal long, text string"
    texts = [(kb, f"d{n}", f"{kb}{n}", n, f"w0 w{n % 5} w{n}") for kb in ("a", "b") for n in range(20)]
    lex = index.build_lexical_index(spark.createDataFrame(texts, kind))
    asked = spark.createDataFrame([("a", "w0"), ("a", "w7"), ("b", "w3"), ("b", "other"), ("c", "w0")], "kb_id string, term string")
    want = {(r["kb_id"], r["term"]): r["idf"] for r in lex.terms.join(asked, ["kb_id", "term"]).collect()}
    got = {(r["kb_id"], r["term"]): r["idf"] for r in index.asked_weights(replace(lex, terms=None), asked).collect()}
    assert got.keys() == want.keys() and got == pytest.approx(want)


def test_request_records_ship_their_sources(spark, monkeypatch):
    from types import SimpleNamespace

    from workload import logs

    asked = spark.createDataFrame([(1, "q", "balanced", 0.5)], "query_id long, question string, route string, alpha double")
    ranked = spark.createDataFrame([], "query_id long, fusion_rank int")
    found = SimpleNamespace(questions=asked, fused=ranked, final=ranked, params=RetrievalParams(top_n=30, rerank_top_k=10))
    shipped = []

    def source_rows(*parts, questions=None, per_question=0):
        shipped.append((questions is asked, per_question))
        if len(shipped) == 2:
            raise StopIteration

    monkeypatch.setattr(logs, "run_hybrid", lambda *a, **k: found)
    monkeypatch.setattr(logs, "_source_chunks", lambda *a: None)
    monkeypatch.setattr(logs.telemetry, "source_rows", source_rows)
    with pytest.raises(StopIteration):
        logs.request_records(spark, "")
    assert shipped == [(True, 60), (True, 10)]
