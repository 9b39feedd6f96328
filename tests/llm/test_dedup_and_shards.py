import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docquarry.llm import components, exact_dedup, line_dedup, sharding, simhash

# Extra columns named like results and intermediates; ids and texts with every odd case.
SCHEMA = "doc_id bigint, text string, digest string, candidate int, slot string, fp double, tokens string"
LONG = "alpha beta " * 20_000


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 0.5, "z") for i, t in rows], SCHEMA)


ROWS = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (4, "a b"), (5, LONG), (6, LONG), (None, "a b"), (7, "é ü")]


def test_exact_duplicates(spark):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.duplicate_classes(table(spark, ROWS)).collect()}
    assert len(got) == 8
    for (doc_id, digest), row in got.items():
        same = [i for i, t in ROWS if hashlib.sha256((t or "").encode()).hexdigest() == digest]
        assert row.keep_id == max(i for i in same if i is not None)
        assert row.group_size == len(same)
        assert row.kept == (doc_id == row.keep_id)


def test_exact_duplicates_of_nothing(spark):
    empty = table(spark, [])
    assert exact_dedup.duplicate_classes(empty).collect() == []
    assert exact_dedup.deduplicate(empty).collect() == []


def test_deduplicated_rows_keep_their_columns(spark):
    left = exact_dedup.deduplicate(table(spark, ROWS))
    assert left.columns == table(spark, ROWS).columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 6, 7]


def test_exact_duplicates_without_a_sent_filter(spark, monkeypatch):
    rows = [(i, str(i % 40)) for i in range(200)]
    want = sorted(map(tuple, exact_dedup.duplicate_classes(table(spark, rows)).collect()))
    monkeypatch.setattr(exact_dedup, "MAX_SENT_WORDS", -1)
    assert sorted(map(tuple, exact_dedup.duplicate_classes(table(spark, rows)).collect())) == want
    assert {r[2] for r in want} == {5}


def test_shards(spark):
    rows = ROWS + [(i, "w" * (i % 97)) for i in range(100, 900)]
    got = sharding.shard_documents(table(spark, rows), 40).collect()
    assert len(got) == len(rows)
    loads, slots = [0] * 40, [[] for _ in range(40)]
    sizes = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r.size, r.text_crc32) for r in got) == sizes
    for r in got:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.next_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    # The two long texts fill a shard each; the rest is even.
    rest = sorted(loads)[:-2]
    assert max(rest) - min(rest) <= 2 * max(s for s, _ in sizes if s < 1000)
    assert sharding.shard_documents(table(spark, []), 40).collect() == []


def test_slot_map_versions(spark, tmp_path):
    slots = spark.createDataFrame([(i, 100 + i % 7, 1) for i in range(400)], "virtual_slot int, bytes bigint, rows bigint")
    first = sharding.first_map(slots, 4)
    second = sharding.grow(first, slots, 6)
    path = str(tmp_path / "map")
    sharding.save_map(first, path)
    sharding.save_map(second, path)
    stored = spark.read.parquet(path)
    newest = {r.virtual_slot: r.shard for r in sharding.read_map(stored).collect()}
    oldest = {r.virtual_slot: r.shard for r in sharding.read_map(stored, 1).collect()}
    assert all(newest[s] in (oldest[s], 4, 5) for s in oldest)
    loads = [sum(100 + s % 7 for s in newest if newest[s] == k) for k in range(6)]
    assert max(loads) - min(loads) <= 4 * 107


def brute_fingerprint(text, words=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, radius):
    low = dict.fromkeys(prints)
    for p in prints:
        if low[p] is None:
            low[p], todo = p, [p]
            while todo:
                at = todo.pop()
                for q in prints:
                    if low[q] is None and bin(at ^ q).count("1") <= radius:
                        low[q] = p
                        todo.append(q)
    return low


def test_fingerprints(spark):
    odd = ["A\x1cB c\x85d E", "one", "one  two", "x\ty\nz\x0bw\x0cv", "İ İ İ İ", " a b c d", LONG, None, "", " \n"]
    rows = list(enumerate(odd))
    got = dict(map(tuple, simhash.fingerprints(table(spark, rows)).collect()))
    assert {i: v % (1 << 64) for i, v in got.items()} == {i: brute_fingerprint(t) for i, t in rows}


@pytest.mark.parametrize("max_tree", [20_000, 8])
def test_near_duplicates(spark, max_tree):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(6)]
    prints = {0}
    for b in base:
        for _ in range(60):
            prints.add(b)
            b ^= 1 << random.randrange(64)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    edges = simhash.fingerprint_links(frame, 2, max_tree)
    roots = {r.node: r.root for r in components.smallest_reachable(edges).collect()}
    want = brute_components(sorted(prints), 2)
    classes = {}
    for p in prints:
        s = p - (1 << 64) if p >= 1 << 63 else p
        classes.setdefault(want[p], set()).add(roots.get(s, s))
    assert all(len(c) == 1 for c in classes.values())
    assert len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_near_duplicate_documents(spark):
    rows = ROWS + [(20, " "), (21, "solo words here now")]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {}
    for (i, t) in rows:
        prints.setdefault(brute_fingerprint(t), []).append(i)
    low = brute_components(sorted(prints), 2)
    smallest = {}
    for p, ids in prints.items():
        smallest.setdefault(low[p], []).extend(i for i in ids if i is not None)
    for r in got:
        assert r.component_id == min(smallest[low[int(r.fingerprint, 16)]])
    assert simhash.near_duplicates(table(spark, [])).collect() == []
    left = simhash.deduplicate(table(spark, rows))
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == sorted({min(v) for v in smallest.values()})


def test_bk_forest_follows_every_link():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 4, 400))
    prints = rng.integers(0, 1 << 10, 400).astype(np.uint64)
    order = np.lexsort((prints, keys))
    pairs = np.unique(np.stack([keys[order].astype(np.uint64), prints[order]], axis=1), axis=0)
    keys, prints = pairs[:, 0].astype(np.int64), pairs[:, 1]
    found = set()
    for a, b in simhash.Forest(keys, prints).links(2):
        found |= set(zip(a.tolist(), b.tolist()))
    want = {
        (i, j)
        for i in range(len(keys))
        for j in range(len(keys))
        if i != j and keys[i] == keys[j] and bin(int(prints[i] ^ prints[j])).count("1") <= 2
    }
    assert found == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (70, 69)], "u bigint, v bigint")
    got = {r.node: r.root for r in components.smallest_reachable(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 70: 69}


def brute_lines(rows):
    """Line numbers that go, by comparing each line with all earlier ones."""
    places = []
    for i, t in sorted(set((i, t) for i, t in rows if t is not None), key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate(t.split("\n")):
            words = frozenset(w for w in __import__("re").split(r"[\x20\x09-\x0D]+", line.lower()) if w)
            if words:
                places.append((i, n, words))
    gone = {}
    for k, (i, n, words) in enumerate(places):
        for _, _, other in places[:k]:
            if len(words & other) * 180 >= (len(words) + len(other)) * 80:
                gone.setdefault(i, []).append(n)
                break
    return gone


def noisy_rows(count, seed):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    lines = [" ".join(random.choice(vocabulary) for _ in range(random.randint(1, 25))) for _ in range(30)]
    rows = []
    for i in range(count):
        own = []
        for _ in range(random.randint(0, 6)):
            words = random.choice(lines).split()
            for _ in range(random.randint(0, 3)):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            own.append(" ".join(words))
        rows.append((i, "\n".join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_lines(spark, seed):
    rows = noisy_rows(80, seed) + [(500, None), (501, ""), (502, "\n \n"), (503, LONG), (504, LONG + "gamma")]
    got = {r.doc_id: r for r in line_dedup.count_repeated(table(spark, rows)).collect()}
    assert {i: r.removed for i, r in got.items() if r.removed} == brute_lines(rows)
    assert len(got) == len(rows) and got[500].n_lines == 0 and got[501].n_lines == 1


def test_texts_without_repeated_lines(spark):
    rows = [(1, "one two\nthree four\n\nfive"), (2, "One TWO\nother"), (2, "One TWO\nother"), (3, None), (None, "five\nsix")]
    docs = table(spark, rows)
    left = line_dedup.remove_repeated(docs)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    # A NULL id comes before all others.
    assert got == sorted(
        [(1, "one two\nthree four\n"), (2, "other"), (2, "other"), (3, None), (None, "five\nsix")], key=repr
    )
    assert line_dedup.remove_repeated(table(spark, [])).collect() == []


def test_lines_are_cut_at_all_white_space(spark):
    rows = [(1, "One\ttwo\x0bthree\x0cfour\rfive"), (2, " one  two three four five "), (3, "\n\t\none two three four six")]
    got = {r.doc_id: r.removed for r in line_dedup.count_repeated(table(spark, rows)).collect()}
    assert got == {1: [], 2: [0], 3: []}
    assert brute_lines(rows) == {2: [0]}


def test_variants_of_a_line_meet_one_partner_each(spark):
    """The first pass gives a row for each variant, not one for each of its words."""
    base = [f"b{k}" for k in range(40)]
    lines = [" ".join(base)] + [" ".join(base[:-1] + [f"v{n}"]) for n in range(60)]
    # Every other word of the base has an earliest set of its own.
    rows = [(n, f"{word} x{n} y{n}") for n, word in enumerate(base)] + [(100 + n, line) for n, line in enumerate(lines)]
    docs = table(spark, rows).selectExpr("doc_id", "xxhash64(text) AS th", "text")
    levels = line_dedup.rarity_levels(docs)
    cut = line_dedup.split_lines(line_dedup.ranked(docs)[0], levels, line_dedup.BUCKETS)
    sets = line_dedup.word_sets(line_dedup.described_lines(cut, 80))
    pairs = line_dedup._nearest_heads(sets, 80).collect()
    assert len({p.x for p in pairs}) == len(pairs) <= 60
    got = {r.doc_id for r in line_dedup.count_repeated(table(spark, rows)).collect() if r.removed}
    assert got == set(brute_lines(rows)) == set(range(101, 161))


def test_all_words_of_all_texts_are_counted(spark):
    """20,000 texts and 100,000 words, each seen twice; neither texts nor words have a bound."""
    docs = spark.range(20_000).selectExpr(
        "id AS doc_id", "concat_ws(' ', 'common', transform(sequence(0, 9), k -> concat('W', (id * 10 + k) % 100000))) AS text"
    )
    rows = docs.selectExpr("doc_id", "xxhash64(text) AS th", "text")
    mask = line_dedup.BUCKETS - 1
    words = [f"w{n}" for n in range(100_000)]
    places = spark.createDataFrame([(w,) for w in ["common", *words]], "w string").selectExpr("w", f"xxhash64(w) & {mask} AS b")
    counts = {}
    place = {r.w: r.b for r in places.collect()}
    for word, b in place.items():
        counts[b] = counts.get(b, 0) + (20_000 if word == "common" else 2)
    levels = spark.range(1).select(line_dedup.rarity_levels(rows).alias("l")).first().l
    assert len(levels) == line_dedup.BUCKETS
    assert all(levels[b] > 0 for b in counts) and sum(level > 0 for level in levels) == len(counts)
    # Never against the order of the counts, and at most a quarter is frequent.
    ordered = [levels[b] for b in sorted(range(len(levels)), key=lambda b: counts.get(b, 0))]
    assert ordered == sorted(ordered)
    found = line_dedup.word_counts(rows)
    assert {b: int(found[b]) for b in found.nonzero()[0]} == counts
    assert 0 < sum(level >= line_dedup.FREQUENT for level in levels) <= line_dedup.BUCKETS // line_dedup.FREQUENT_SHARE


def test_tables_on_the_way_go(spark):
    """Line removal and near-duplicates leave no table that is read no more, nor files of their exchanges."""
    import glob
    import os

    from docquarry.llm import near_sets
    from docquarry.session import scratch_dir

    root = os.path.dirname(scratch_dir(spark, "any")).removeprefix("file://")
    before = set(glob.glob(f"{root}/*"))
    docs = table(spark, noisy_rows(60, 3))
    lines = line_dedup.remove_repeated(docs)
    near = near_sets.deduplicate(docs, by_print=True)
    left = {os.path.basename(p).rsplit("-", 1)[0] for p in set(glob.glob(f"{root}/*")) - before}
    assert left == {"lines-found", "near-firsts", "near-repeats"}
    assert lines.count() == 60 and near.count() <= 60
