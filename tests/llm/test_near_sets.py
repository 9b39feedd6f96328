import random

import corpus_pipeline
import pytest

from docquarry.llm import near_sets, simhash


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, th string")


def brute_sets(text):
    parts = (text or "").encode().lower().split()
    if 0 < len(parts) < 5:
        return {b" ".join(parts)}
    return {b" ".join(parts[i : i + 5]) for i in range(len(parts) - 4)}


def brute_kept(rows):
    """The smallest id of each component of sets of similarity 0.8."""
    sets = [brute_sets(t) for _, t in rows]
    low = list(range(len(rows)))

    def find(k):
        while low[k] != k:
            k = low[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 180 >= (len(sets[a]) + len(sets[b])) * 80:
                low[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return sorted(min(ids) for ids in groups.values())


def varied(seed):
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        words = [f"b{base}w{rng.randrange(400)}" for _ in range(rng.choice((3, 30, 120)))]
        for _ in range(8):
            own = list(words)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(9)}"
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_all_similar_documents_link(spark, seed):
    rows = varied(seed) + [(900, None), (901, " \n"), (902, "One two"), (903, "one  TWO")]
    left = near_sets.deduplicate(docs_of(spark, rows))
    assert left.columns == ["doc_id", "text", "th"]
    assert sorted(r.doc_id for r in left.collect()) == brute_kept(rows)


def test_pipeline_finds_copies_with_edits_through_the_text(spark):
    words = [f"w{k}" for k in range(200)]
    edited = list(words)
    for k in (20, 90, 160):
        edited[k] = "edit"
    sentence = "again and again the very same words "
    rows = [
        (1, " ".join(words)),
        (2, " ".join(edited)),
        # Equal fingerprints of counted shingles, but few shingles in common.
        (3, sentence * 300 + " ".join(f"x{k}" for k in range(60))),
        (4, sentence * 300 + " ".join(f"y{k}" for k in range(60))),
    ]
    prints = [simhash.fingerprint(t.encode(), 5) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() > 3 and (prints[2] ^ prints[3]).bit_count() <= 3
    left = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs_of(spark, rows), "")
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4]


def test_rows_of_one_id_and_rows_without(spark):
    rows = [(1, "a b c"), (1, "d e f"), (1, "d e f"), (2, "a b c"), (None, "a b c"), (None, "d e f")]
    left = near_sets.deduplicate(docs_of(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=repr) == sorted(
        [(1, "a b c"), (1, "d e f"), (None, "a b c"), (None, "d e f")], key=repr
    )
    assert near_sets.deduplicate(docs_of(spark, [])).collect() == []


def test_sets_meet_by_linked_fingerprints(spark, monkeypatch):
    """Fingerprints within the radius are pairs to verify; the pipeline asks for them."""
    sets = spark.createDataFrame([(5, 0), (7, 3), (9, 0), (2, -1), (11, 12)], "number bigint, fp bigint")
    assert sorted(tuple(r) for r in near_sets.print_pairs(sets).collect()) == [(7, 5), (9, 5), (11, 5)]
    asked = []
    found = near_sets.print_pairs
    monkeypatch.setattr(near_sets, "print_pairs", lambda sets: asked.append(1) or found(sets))
    words = " ".join(f"w{k}" for k in range(400))
    rows = [(1, words), (2, words + " end"), (3, "something else of some words")]
    left = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs_of(spark, rows), "")
    assert sorted(r.doc_id for r in left.collect()) == [1, 3] and asked
