"""Shards from fixed virtual slots.

Every record is hashed into one of ``VIRTUAL_SLOTS`` slots for good.  Bytes are
summed per slot, and a slot map, a small versioned table, says which shard holds
which slot.  The first version places the slots by size, largest first, on the
least loaded shard; a later version edits the map and moves as few slots as it
needs (:func:`grow`).  Nothing but the map has to change when shards do.

The map has ``VIRTUAL_SLOTS`` rows whatever the corpus, so placing it is one row
of bounded size and it may be broadcast.  Records are hashed by id and text, so
a group of copies spreads over all slots.

Defined cases: a NULL text has no bytes (size 16, CRC 0); NULL ids and repeated
rows are records like any other and get a slot position each; an empty table
gives an empty result.  Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import narrow, settle

VIRTUAL_SLOTS = 4096
ROW_BYTES = 16


def slot_of(id_: Column, text: Column, slots: int = VIRTUAL_SLOTS) -> Column:
    return F.pmod(F.xxhash64(id_, text), F.lit(slots)).cast("int")


def sized_records(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = VIRTUAL_SLOTS
) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot); the only read of the texts."""
    text = F.col(text_col)
    return narrow(
        docs,
        id_col,
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        slot_of(F.col(id_col), text, slots).alias("virtual_slot"),
    )


def slot_bytes(records: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows) of the slots in use."""
    return records.groupBy("virtual_slot").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows")
    )


def first_map(slots: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map (version, virtual_slot, shard): largest slot to the least loaded shard.

    One row holds all slots (at most ``VIRTUAL_SLOTS``) and folds over them with
    the loads kept in order, smallest first.
    """
    ordered = slots.agg(
        F.sort_array(
            F.collect_list(F.struct((-F.col("bytes")).alias("load"), "virtual_slot"))
        ).alias("slots")
    )
    folded = ordered.select(
        "slots",
        F.expr(
            f"""aggregate(
                slots,
                named_struct(
                    'loads', transform(sequence(0, {int(shards) - 1}), i -> struct(0L, i)),
                    'shards', cast(array() as array<int>)),
                (acc, s) -> named_struct(
                    'loads', array_sort(array_append(
                        slice(acc.loads, 2, {int(shards)}),
                        struct(acc.loads[0].col1 - s.load, acc.loads[0].i))),
                    'shards', array_append(acc.shards, acc.loads[0].i)),
                acc -> acc.shards)"""
        ).alias("shards"),
    )
    return folded.select(F.posexplode("shards").alias("n", "shard"), "slots").select(
        F.lit(1).alias("version"),
        F.col("slots")[F.col("n")]["virtual_slot"].alias("virtual_slot"),
        F.col("shard").cast("int").alias("shard"),
    )


def grow(slot_map: DataFrame, slots: DataFrame, shards: int) -> DataFrame:
    """The next version for ``shards`` shards, more than now: slots move to the new ones only.

    Each shard gives up its smallest slots, as many as fit into what it holds
    above the new mean; the given-up bytes are cut into equal runs, one run per
    new shard.  All windows run over the bounded map.
    """
    known = slot_map.join(F.broadcast(slots), "virtual_slot")
    whole = Window.partitionBy()
    own = Window.partitionBy("shard")
    filled = own.orderBy("bytes", "virtual_slot")
    taken = known.select(
        "*",
        (F.sum("bytes").over(own) - F.sum("bytes").over(whole) / F.lit(shards)).alias("excess"),
        F.sum("bytes").over(filled).alias("given"),
        F.max("shard").over(whole).alias("last"),
    ).withColumn("moves", F.col("given") <= F.col("excess"))
    run = Window.partitionBy("moves").orderBy("shard", "bytes", "virtual_slot")
    cut = F.floor(
        (F.sum("bytes").over(run) - F.col("bytes"))
        * (F.lit(shards - 1) - F.col("last"))
        / F.sum("bytes").over(Window.partitionBy("moves"))
    )
    return taken.withColumn("target", F.col("last") + 1 + cut).select(
        (F.col("version") + 1).alias("version"),
        "virtual_slot",
        F.when(F.col("moves"), F.col("target")).otherwise(F.col("shard")).cast("int").alias("shard"),
    )


def save_map(slot_map: DataFrame, path: str) -> None:
    """Append a version; earlier ones stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def read_map(slot_map: DataFrame, version: int | None = None) -> DataFrame:
    """One version of a stored map, the newest by default."""
    if version is not None:
        return slot_map.filter(F.col("version") == version)
    newest = slot_map.agg(F.max("version").alias("version"))
    return slot_map.join(F.broadcast(newest), "version", "left_semi")


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with their shard, by the map."""
    return records.join(F.broadcast(slot_map), "virtual_slot")


def numbered(assigned: DataFrame, slots: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add ``slot``: the record's position in its shard, without gaps.

    Positions are counted inside virtual slots, which are small and even; each
    slot starts where the slots before it in its shard end.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot")
    starts = (
        slot_map.join(F.broadcast(slots), "virtual_slot")
        .withColumn("start", F.sum("rows").over(before) - F.col("rows"))
        .select("virtual_slot", "start")
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        assigned.join(F.broadcast(starts), "virtual_slot")
        .withColumn("slot", F.col("start") + F.row_number().over(inside) - 1)
        .drop("start")
    )


def shard_documents(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    slots: int = VIRTUAL_SLOTS,
) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot, map_version, next_shard).

    ``shard`` follows version 1 of the map, near equal in bytes; ``next_shard``
    follows the edited version for one more shard.
    """
    records = settle(sized_records(docs, id_col, text_col, slots), "records")
    sums = settle(slot_bytes(records), "slot-bytes")
    current = settle(first_map(sums, shards), "slot-map")
    edited = grow(current, sums, shards + 1)
    return (
        numbered(assign(records, current), sums, current)
        .join(
            F.broadcast(edited.select("virtual_slot", F.col("shard").alias("next_shard"))),
            "virtual_slot",
        )
        .withColumn("map_version", F.lit(1))
    )
