"""Neighbours, hard negatives and the prefix trie against brute force."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import block_neighbours, hard_negatives, prefix_trie

VECTORS = "vec_id bigint, embedding array<float>, score string, id string, vector int"
INTEGERS = "vec_id bigint, label int, embedding array<bigint>, anchor string, r int"
TURNS = "conv_id bigint, turn bigint, role string, text string, key string, pos int"


def narrow(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def random_vectors(seed, n=150, d=9):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [narrow(rng.gauss(0, 1) * 10 ** rng.choice((-3, 0, 0, 2))) for _ in range(d)]
        rows.append((i, v))
    rows += [(n + i, list(rows[7][1])) for i in range(60)]  # copies: ties
    rows += [(300, [0.0] * d), (301, None), (302, [1.0, None]), (303, [math.nan] * d), (304, [math.inf, 1.0]), (305, [])]
    rows += [(320, [1.0, 2.0]), (340, [narrow(0.1)]), (None, [1.0] * d), (12, [5.0] * d), rows[0], rows[0]]
    return rows


def usable(v, zero=False):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def brute_nearest(rows, every, k):
    rows = [r for r in rows if r[0] is not None and usable(r[1])]
    best = {}
    for q, a in rows:
        if q % every == 0:
            own = best.setdefault(q, {})
            for c, b in rows:
                if c != q:
                    own[c] = max(own.get(c, -math.inf), dot(a, b))
    return sorted(
        (q, n + 1, c, s)
        for q, own in best.items()
        for n, (c, s) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:k])
    )


@pytest.mark.parametrize("seed,block_bytes", [(1, 1 << 24), (2, 2000)])
def test_nearest_neighbours(spark, seed, block_bytes):
    rows = random_vectors(seed)
    table = spark.createDataFrame([(i, v, "s", "i", 1) for i, v in rows], VECTORS)
    found = block_neighbours.nearest_neighbours(table, F.col("vec_id") % 5 == 0, 7, block_bytes=block_bytes)
    assert sorted(tuple(r) for r in found.collect()) == brute_nearest(rows, 5, 7)


def test_all_candidates_if_fewer_and_empty(spark):
    rows = [(0, [1.0, 1.0]), (20, [0.5, 0.5]), (3, [-1.0, 0.0])]
    table = spark.createDataFrame([(i, v, "s", "i", 1) for i, v in rows], VECTORS)
    found = block_neighbours.nearest_neighbours(table, F.col("vec_id") % 20 == 0, 20)
    assert sorted(tuple(r) for r in found.collect()) == brute_nearest(rows, 20, 20)
    for nothing in (table.limit(0), table.filter("vec_id = 3")):
        assert block_neighbours.nearest_neighbours(nothing, F.col("vec_id") % 20 == 0, 20).count() == 0


@pytest.mark.parametrize("scale", [1e-25, 1.0, 1e18])
def test_bounds_hold_the_true_product(scale):
    rng = np.random.default_rng(5)
    q = rng.normal(size=(40, 33)) * scale * 10.0 ** rng.integers(-4, 4, (40, 1))
    c = rng.normal(size=(70, 33)) * scale * 10.0 ** rng.integers(-4, 4, (70, 1))
    a, b = block_neighbours.Rounded(q), block_neighbours.Rounded(c)
    near, off = block_neighbours.bounds(a, slice(None), b, slice(None))
    true = (q / a.unit) @ (c / b.unit).T
    assert (np.abs(near - true) <= off).all()


def test_survivors_are_few():
    """On vectors of one length the bounds leave a small part of the pairs to be computed again."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(4000, 64))
    rows /= np.sqrt((rows**2).sum(axis=1, keepdims=True))
    a, b = block_neighbours.Rounded(rows[:50]), block_neighbours.Rounded(rows)
    near, off = block_neighbours.bounds(a, slice(None), b, slice(None))
    floor = np.partition(near - off, -21, axis=1)[:, -21:-20]
    assert (near + off >= floor).mean() < 0.02


def random_integers(seed, n=160, d=6):
    rng = random.Random(seed)
    rows = [(i, rng.choice((0, 1, 2, 3)), [rng.randrange(-60, 200) for _ in range(d)]) for i in range(n)]
    rows += [(n + i, i % 2, list(rows[10][2])) for i in range(70)]
    rows += [(400, 0, [0] * d), (401, 1, [0] * d), (410, 2, None), (411, None, [1] * d), (412, 1, [1, None]), (420, 1, [])]
    rows += [(430, 1, [5, 5]), (None, 1, [3] * d), (440, 3, [-50] * d), (450, 9, [1] * d), rows[0], rows[0], (20, 1, [7] * d)]
    return rows


def brute_negatives(rows, every, positives, negatives):
    rows = list({(i, l, tuple(v)) for i, l, v in rows if None not in (i, l) and v is not None and None not in v})
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, l == label) for i, l, w in rows if i != a)
        for p, i, _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p]
            out += [(a, i, n + 1, s[1], -p, -s[0]) for n, s in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("seed,block_bytes", [(1, 1 << 24), (2, 2500)])
def test_hard_negatives(spark, monkeypatch, seed, block_bytes):
    rows = random_integers(seed)
    table = spark.createDataFrame([(*r, "a", 0) for r in rows], INTEGERS)
    found = hard_negatives.mine(table, F.col("vec_id") % 10 == 0, block_bytes=block_bytes)
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows, 10, 5, 10)


def test_hard_negatives_of_nothing(spark):
    table = spark.createDataFrame([(1, 1, [1, 2], "a", 0), (10, 2, [1, 2], "a", 0)], INTEGERS)
    for part in (table.limit(0), table.filter("vec_id = 1"), table):
        assert hard_negatives.mine(part, F.col("vec_id") % 10 == 0).count() == 0


def test_coordinate_ranges_lose_nothing_and_cut():
    """Every row that reaches the product is in the intersection; most others are not."""
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(2000, 5))
    rows = np.floor(rows / np.sqrt((rows**2).sum(axis=1, keepdims=True)) * rng.uniform(900, 1000, (2000, 1))).astype(np.int64)
    (bucket,) = hard_negatives.make_buckets(np.arange(2000), np.zeros(2000, int), rows, 2000)
    cut = 0
    for n in range(40):
        anchor = hard_negatives.Anchor(-1, 0, rows[n])
        scores = bucket.rows @ rows[n]
        for least in (0.0, float(scores.max()) * 0.6, -float(scores.max()) * 0.2):
            at = bucket.feasible(anchor, least)
            reached = np.nonzero(scores >= least)[0]
            assert at is None or np.isin(reached, at).all()
            cut += least > 0 and at is not None and len(at) < 900
    assert cut > 30


def brute_trie(rows, every, most):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        made[c] = tuple(own.get(c - c % every, [])[:h] + own[c][h:])
    members = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = []
    for node, inside in members.items():
        subtree = [n for n in members if n[: len(node)] == node]
        children = [n for n in subtree if len(n) == len(node) + 1]
        leaves = [n for n in subtree if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in subtree)]
        ends = ",".join(str(c) for c in sorted(c for c in inside if len(made[c]) == len(node)))
        out.append(
            (
                min(inside),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(inside),
                len(children),
                len(leaves),
                sum((len(members[n]) - 1) * len(n[-1][1]) for n in subtree if n),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def trie_of(spark, rows):
    number = F.col("conv_id")
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], TURNS)
    found = prefix_trie.conversation_trie(table, number - number % 10, F.crc32(number.cast("string")) % 6, 5)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_prefix_trie(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        for t in range(rng.choice((0, 1, 2, 4, 7, 9))):
            rows.append((c, t, rng.choice("ab"), rng.choice(("x", "yy", "é"))))
    rows += [(70, n, "user", f"t{n}") for n in range(40)] + [(71, n, "user", f"t{n}") for n in range(38)]
    rows += [(75, None, None, None), (75, None, "a", None), (75, 1, "a", "b"), (75, 1, "a", "b"), (75, 1, "a", "a")]
    rows += [(None, 1, "a", "b"), (80, None, None, ""), (95, 3, "", "only")]
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    assert trie_of(spark, rows) == brute_trie(rows, 10, 6)


def test_prefix_trie_of_one_and_none(spark):
    assert trie_of(spark, []) == []
    rows = [(5, 0, "user", "hello")]
    assert trie_of(spark, rows) == brute_trie(rows, 10, 6)


def test_subtree_totals_of_random_trees(spark):
    rng = random.Random(9)
    parents = [None] + [max(0, i - rng.choice((1, 1, 1, 1, 5))) for i in range(1, 120)]
    rows = [(i, p, parents.count(i), 1, rng.randrange(9)) for i, p in enumerate(parents)]
    nodes = spark.createDataFrame(rows, "key bigint, parent bigint, kids bigint, leaves bigint, tokens bigint")
    want = {i: [r[3], r[4]] for i, r in enumerate(rows)}
    for i in range(119, 0, -1):
        for n in (0, 1):
            want[parents[i]][n] += want[i][n]
    found = prefix_trie.subtree_totals(nodes).collect()
    assert sorted(tuple(r) for r in found) == sorted((i, *v) for i, v in want.items())
