"""The trie of conversation prefixes, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns.  A prefix is known by the exclusive-or of two 64-bit
hashes of its (position, role, text) turns, which is a running value along the conversation; it is taken
in blocks of turns, so that no task holds a whole long conversation.  Subtree totals come from
rounds of joins that alternate two steps until only the root is left:

* rake: every leaf goes, adding its total to its parent;
* compress: in chains of nodes with a single child, nodes that rank above both neighbours in a
  hash order of the round go, so that no two neighbours go at once.  The child takes the parent's place
  and carries the node's own values on its edge upwards.

A chain loses about a third of its nodes in a round, a bush all its leaves, so the number of
rounds grows with the logarithm of the nodes.  Every node that goes is written down; going back
through the rounds, the total of a compressed node is its own value plus its child's total and edge.

Cases: turns without a conversation id take no part; NULL role and text count as empty; turns with
equal numbers follow role and text, repeats included.  A turnless conversation is a member of the root
alone.  An empty table has no root and gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import settle

# Turns of a conversation, or ids in a list, that one task sorts together.
BLOCK = 4096
_TOTALS = ("leaves", "tokens")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): turns numbered from 1 by (turn, role, text), NULL turns first.

    Turns are counted by (conversation, block of the turn number) first, so that a long conversation is
    numbered by many tasks; only turns that repeat one number meet in one block.
    """
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("part"),
    )
    sizes = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return (
        rows.withColumn("k", F.row_number().over(inside))
        .join(starts, ["conv_id", "part"])
        .select("conv_id", (F.col("start") + F.col("k")).alias("pos"), "role", "text")
    )


def rebuilt_turns(ordered: DataFrame, base: Column, borrowed: Column, most: int) -> DataFrame:
    """(conv_id, pos, role, text) with the first ``borrowed`` turns taken from conversation ``base``.

    Own turns after the first ``borrowed`` follow.  A conversation all of whose turns are replaced by none
    has no rows.  ``base`` and ``borrowed`` are columns over ``conv_id``; ``most`` bounds ``borrowed``.
    """
    plans = ordered.select("conv_id").distinct().select("conv_id", base.alias("base"), borrowed.alias("h"))
    # At most ``most`` rows a conversation, so a base with many followers stays a short list.
    heads = (
        ordered.filter(F.col("pos") <= most)
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("head"))
    )
    taken = (
        plans.filter("h > 0")
        .join(heads, "base")
        .select("conv_id", F.inline(F.filter("head", lambda t: t["pos"] <= F.col("h"))))
    )
    # Own turns keep their distance: they follow as many turns as the base had, if it had fewer.
    lengths = plans.join(heads.select("base", F.size("head").alias("n")), "base", "left").select(
        "conv_id", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("got")
    )
    own = (
        ordered.join(lengths, "conv_id")
        .filter("pos > h")
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "role", "text")
    )
    return taken.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "role", "text").unionByName(
        own.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "role", "text")
    )


def prefix_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, key, parent, chars, last): the prefix that ends at each turn and the one before it."""
    blocked = turns.select(
        "conv_id",
        "pos",
        F.length("text").alias("chars"),
        F.xxhash64(F.lit("a"), "pos", "role", "text").alias("x"),
        F.xxhash64("text", "role", "pos", F.lit("b")).alias("y"),
        F.floor((F.col("pos") - 1) / BLOCK).alias("part"),
    )
    sums = blocked.groupBy("conv_id", "part").agg(
        F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), F.max("pos").alias("end")
    )
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")

    def so_far(column: str, over) -> Column:
        return F.coalesce(F.bit_xor(column).over(over), F.lit(0))

    carried = sums.select(
        "conv_id",
        "part",
        so_far("bx", earlier).alias("cx"),
        so_far("by", earlier).alias("cy"),
        F.max("end").over(whole).alias("end"),
    )
    before = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    started = (
        blocked.withColumns({"px": so_far("x", before), "py": so_far("y", before)})
        .join(carried, ["conv_id", "part"])
        .withColumns({"px": F.col("px").bitwiseXOR(F.col("cx")), "py": F.col("py").bitwiseXOR(F.col("cy"))})
    )

    def key(depth: Column, x: Column, y: Column) -> Column:
        return F.struct(depth.cast("bigint").alias("d"), x.alias("x"), y.alias("y"))

    depth = F.col("pos")
    return started.select(
        "conv_id",
        "pos",
        key(depth, F.col("px").bitwiseXOR(F.col("x")), F.col("py").bitwiseXOR(F.col("y"))).alias("key"),
        key(depth - 1, F.col("px"), F.col("py")).alias("parent"),
        "chars",
        (depth == F.col("end")).alias("last"),
    )


def _rank(key: str, turn: int) -> Column:
    """A different order of the nodes each round."""
    return F.xxhash64(F.lit(turn), key)


def _up(names) -> list[str]:
    return [f"up_{c}" for c in names]


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(key, leaves, tokens): sums of both columns over each node's subtree.

    ``nodes`` has ``key``, ``parent`` (NULL for the root), the number of its ``kids``, and ``leaves`` and
    ``tokens`` of the node alone.
    """
    live = settle(nodes.withColumns({c: F.lit(0).cast("bigint") for c in _up(_TOTALS)}), "trie")
    done, chains, turn = [live.filter("kids = 0").select("key", *_TOTALS)], [], 0
    while not live.filter("kids > 0").isEmpty():
        # Rake: a leaf's values are its total, and go to its parent over its edge.
        leaf = F.col("kids") == 0
        below = (
            live.filter("parent IS NOT NULL")
            .groupBy(F.col("parent").alias("key"))
            .agg(
                F.count_if(~leaf).alias("left"),
                F.min(F.when(~leaf, F.col("key"))).alias("child"),
                *[F.sum(F.when(leaf, F.col(c) + F.col(f"up_{c}"))).alias(f"more_{c}") for c in _TOTALS],
            )
        )
        # Compress: a node with one child left knows the keys of its neighbours, and so their ranks.
        above = (_rank("key", turn) > _rank("parent", turn)) & (_rank("key", turn) > _rank("child", turn))
        raked = settle(
            live.filter(~leaf)
            .join(below, "key")
            .select(
                "key",
                "parent",
                *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in _TOTALS],
                *_up(_TOTALS),
                F.col("left").alias("kids"),
                "child",
                F.coalesce((F.col("left") == 1) & F.col("parent").isNotNull() & above, F.lit(False)).alias("out"),
            ),
            "raked",
        )
        out = raked.filter("out").select(
            F.col("child").alias("key"),
            F.col("key").alias("via"),
            F.col("parent").alias("over"),
            *[F.col(c).alias(f"via_{c}") for c in _TOTALS],
            *[F.col(f"up_{c}").alias(f"lift_{c}") for c in _TOTALS],
        )
        joined = settle(raked.filter("NOT out").drop("child", "out").join(out, "key", "left"), "contracted")
        live = joined.select(
            "key",
            F.coalesce("over", "parent").alias("parent"),
            *_TOTALS,
            *[
                (F.col(f"up_{c}") + F.coalesce(F.col(f"via_{c}") + F.col(f"lift_{c}"), F.lit(0))).alias(f"up_{c}")
                for c in _TOTALS
            ],
            "kids",
        )
        # A compressed node has its own values and what comes over its child's edge as it was.
        chains.append(
            (
                len(done),
                joined.filter("via IS NOT NULL").select(
                    F.col("key").alias("child"),
                    F.col("via").alias("key"),
                    *[(F.col(f"via_{c}") + F.col(f"up_{c}")).alias(c) for c in _TOTALS],
                ),
            )
        )
        done.append(live.filter("kids = 0").select("key", *_TOTALS))
        turn += 1
    # Back through the rounds: the child of a compressed node went later, so its total is known.
    totals = None
    for first, chain in reversed(chains):
        known = _union(done[first:], totals)
        del done[first:]
        of = known.withColumnsRenamed({"key": "child", **{c: f"of_{c}" for c in _TOTALS}})
        back = chain.join(of, "child").select("key", *[(F.col(c) + F.col(f"of_{c}")).alias(c) for c in _TOTALS])
        totals = settle(known.unionByName(back), "expanded")
    return _union(done, totals)


def _union(parts: list[DataFrame], more: DataFrame | None) -> DataFrame:
    whole = more
    for part in parts:
        whole = part if whole is None else whole.unionByName(part)
    return whole


def _list_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which follow each other in order, comma between them."""
    current, state = None, None
    for batch in batches:
        names, hashes = [], []
        for name, piece in zip(batch["node"].to_pylist(), batch["piece"].to_pylist()):
            if name != current:
                if current is not None:
                    names.append(current)
                    hashes.append(state.hexdigest())
                current, state = name, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield pa.RecordBatch.from_pydict({"node": names, "ends_sha256": hashes}, schema=_HASHED)
    if current is not None:
        yield pa.RecordBatch.from_pydict({"node": [current], "ends_sha256": [state.hexdigest()]}, schema=_HASHED)


_HASHED = pa.schema([("node", pa.string()), ("ends_sha256", pa.string())])


def list_digests(members: DataFrame) -> DataFrame:
    """(key, ends_sha256): hash of each key's ``conv_id`` values, ascending and comma-joined.

    Ids are joined in pieces first: a range of ids is a piece of a key, so a key with a great part of all ids is
    sorted by many tasks, and the one task that hashes it reads its pieces in order, one at a time.
    """
    ids = members.withColumn("piece_no", F.floor(F.col("conv_id") / BLOCK))
    pieces = ids.groupBy("key", "piece_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("piece")
    )
    node = F.concat_ws(":", F.col("key.d"), F.col("key.x"), F.col("key.y"))
    hashed = (
        pieces.select(node.alias("node"), "piece_no", "piece")
        .repartition("node")
        .sortWithinPartitions("node", "piece_no")
        .select("node", "piece")
        .mapInArrow(_list_hashes, "node string, ends_sha256 string")
    )
    part = F.split("node", ":")
    return hashed.select(
        F.struct(*[part[i].cast("bigint").alias(c) for i, c in enumerate("dxy")]).alias("key"), "ends_sha256"
    )


def build(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row a node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns`` has ``conv_id``, ``pos`` from 1 without gaps, ``role`` and ``text``; ``conversations`` the
    ``conv_id`` of all conversations, turnless ones too.
    """
    steps = settle(prefix_keys(turns), "prefixes")
    root = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in "dxy"])
    turnless = conversations.join(steps.filter("pos = 1").select("conv_id"), "conv_id", "left_anti")
    top = conversations.groupBy(root.alias("key")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    made = (
        steps.groupBy("key")
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("chars").alias("chars"))
        .unionByName(top.withColumns({"parent": F.lit(None).cast("struct<d:bigint,x:bigint,y:bigint>"), "chars": F.lit(0)}))
    )
    nodes = settle(made, "nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = settle(
        nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes"
    )
    totals = subtree_totals(
        nodes.select(
            "key",
            "parent",
            F.col("n_children").alias("kids"),
            F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("tokens"),
        )
    )
    ends = list_digests(
        steps.filter("last").select("key", "conv_id").unionByName(turnless.select(root.alias("key"), "conv_id"))
    )
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(parents, "parent", "left")
        .join(totals, "key")
        .join(ends, "key", "left")
        .select(
            "conv_id",
            F.col("key.d").alias("depth"),
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.col("leaves").alias("n_leaves"),
            F.col("tokens").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )


def conversation_trie(turns: DataFrame, base: Column, borrowed: Column, most: int) -> DataFrame:
    """The trie of the conversations of ``turns`` (conv_id, turn, role, text), rebuilt as ``rebuilt_turns`` says."""
    ordered = settle(ordered_turns(turns), "turns")
    rebuilt = rebuilt_turns(ordered, base, borrowed, most)
    return build(rebuilt, ordered.select("conv_id").distinct())
