"""What a task holds does not follow the rows of its batch."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

from docquarry.llm import language_id, sentencepiece_fst
from docquarry.llm.queries import PIECE_MODEL
from docquarry.operators import chunking, index, inplace, integrity


def peak_of(work):
    tracemalloc.start()
    result = work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return result, peak


def test_windows_are_python_objects_by_slices():
    texts = pa.array(["some words of a text " * 60, None, ""] * 2_000)
    found, peak = peak_of(lambda: chunking.windows_of(texts, 100, 20))
    assert peak < 4e6
    assert len(found) == 6_000 and found[1].as_py() is None and found[2].as_py() == []
    body = texts[0].as_py()
    assert [(c["start"], c["stop"], c["text"]) for c in found[-3].as_py()] == chunking.cut(body, 100, 20)


def test_places_of_terms_are_not_kept_without_bound(monkeypatch):
    monkeypatch.setattr(index, "REMEMBERED_TERMS", 1_000)
    texts = pd.Series([" ".join(f"t{row}x{k}" for k in range(200)) for row in range(500)])
    small = np.concatenate([index.hashed_terms()(texts[row : row + 1]) for row in range(500)])
    made, peak = peak_of(lambda: index.hashed_terms()(texts))
    assert np.array_equal(made, small)
    assert peak < 3e6


def test_scores_that_cannot_be_among_the_best_do_not_wait():
    best = inplace.Best(2, 3)
    assert best.least.tolist() == [-np.inf] * 3
    add = lambda *cells: best.add(*[np.array(c) for c in zip(*cells)])
    add((0, 5.0, 1, 10), (0, 3.0, 2, 11), (0, 3.0, 0, 12), (2, 1.0, 4, 13))
    assert best.least.tolist() == [3.0, -np.inf, -np.inf]
    assert best.kept[3].tolist() == [10, 12, 13]


def test_tables_are_cut_to_their_bases_before_they_are_compared(spark):
    bases = spark.createDataFrame([("a",), ("b",)], "kb_id string")
    rows = spark.createDataFrame([("a", 1)] * 5, "kb_id string, x int")
    found = integrity.base_completeness(bases, rows, rows, rows, rows)
    assert sorted(tuple(r) for r in found.collect()) == [
        (r, "b") for r in ("no_chunks", "no_documents", "no_postings", "no_vectors")
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [kb_id") == 8


def test_pieces_are_python_objects_by_slices():
    """However many whole texts a batch has, what was made of one slice goes before the next."""
    machine = sentencepiece_fst.Transducer(sentencepiece_fst.load_model(PIECE_MODEL))
    texts = pa.array(["some words of a text " * 60, None, ""] * 2_000)

    def code():
        return [(len(a), a.field(0).null_count, len(a) - a.field(2).null_count - a.field(2).true_count) for a in sentencepiece_fst.coded_slices(machine, [texts])]

    code()
    found, peak = peak_of(code)
    assert peak < 3e6
    assert [sum(n) for n in zip(*found)] == [6_000, 2_000, 0] and max(n for n, *_ in found) <= 256
    parts = pa.concat_arrays(sentencepiece_fst.coded_slices(machine, [texts.slice(250, 20)])).to_pylist()
    assert [p["ids"] for p in parts] == [None if t is None else machine.encode(t) for t in texts.slice(250, 20).to_pylist()]


def test_only_unseen_words_are_remembered():
    model = language_id.Model(["x", "y"], {"known": {"x": 9}}, {"<u": {"y": 9}})
    remembered = {}
    assert model.predict("known known", remembered)[0] == "x" and not remembered
    assert model.predict("known un un", remembered)[0] == "y" and list(remembered) == ["un"]
