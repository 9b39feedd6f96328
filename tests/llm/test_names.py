"""Columns of any name pass through the stages; letters are letters."""

import pytest

from docquarry.llm import decontaminate, exact_dedup, language_id, line_dedup, near_sets

ODD = (
    "row d t th n numbers digest keep_id candidate spans items n_words place component one two group_size "
    "__d __t __th __numbers __word __bits __digest __candidate __keep __contamination __row __block0 __result a.b"
).split()
ROWS = [(1, "one two three four\nfive six"), (2, "one two three four\nseven"), (3, "eight nine ten eleven twelve"), (3, "eight nine ten eleven twelve"), (4, None), (None, "odd one out")]


@pytest.fixture
def docs(spark):
    kind = "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in ODD)
    return spark.createDataFrame([(i, t, *[f"{c}{i}" for c in ODD]) for i, t in ROWS], kind)


def kept(docs, result):
    rows = result.collect()
    assert result.columns == docs.columns
    assert all(list(r[2:]) == [f"{c}{r[0]}" for c in ODD] for r in rows)
    return sorted(((r[0], r[1]) for r in rows), key=repr)


def test_line_removal(docs):
    want = [(i, "seven" if i == 2 else t) for i, t in ROWS]
    assert kept(docs, line_dedup.remove_repeated(docs)) == sorted(want, key=repr)


def test_near_duplicates(docs):
    assert kept(docs, near_sets.deduplicate(docs)) == sorted(set(ROWS), key=repr)


def test_exact_duplicates(docs):
    assert kept(docs, exact_dedup.deduplicate(docs)) == sorted(set(ROWS), key=repr)


def test_contamination(spark, docs):
    bench = spark.createDataFrame([(1, "eight nine ten eleven twelve")], "item_id bigint, text string")
    assert kept(docs, decontaminate.decontaminate(docs, bench)) == sorted([r for r in ROWS if r[0] != 3], key=repr)


def test_numerals_are_no_letters():
    model = language_id.Model(["x", "y"], {"ab": {"x": 9}}, {})
    for text in ("½ ²", "①", "Ⅷ", "3 ½", "", None, "_", "½²"):
        assert model.predict(text, {}) == (language_id.UNDETERMINED, 0.0)
    assert language_id.words_of("Ab½ab ab² d'é 1x") == {"ab": 3, "d": 1, "é": 1, "x": 1}
    assert model.predict("½ ab", {})[0] == "x"
