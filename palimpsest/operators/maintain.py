"""Compaction, mark and sweep, and work that is done a bounded slice at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.keys import LIVE, WHITEOUT
from palimpsest.operators.chain import chains
from palimpsest.operators.visible import newest

#: Fixed values of the data model: frames that a journal may hold before a checkpoint is due, frames of a commit
#: besides its operations, work that needs no log, first data block, block numbers in a free-list block.
JOURNAL_SOFT, COMMIT_FRAMES, UNLOGGED_BUDGET, FIRST_DATA_BLOCK, FREE_PER_BLOCK = 960, 3, 128, 65, 510


def compact_whiteouts(entries: DataFrame, key: Sequence[str], dead: Sequence[int]) -> DataFrame:
    """Newest entries without the whiteouts of dead snapshots, whose older copies go with them."""
    gone = (F.col("kind") == WHITEOUT) & F.col("snap_id").isin([int(s) for s in dead])
    return newest(entries, key).filter(~gone)


def drop_snapshot_keys(entries: DataFrame, key: Sequence[str], dead: Sequence[int]) -> DataFrame:
    """Newest entries of the snapshots that are left. The filter needs no winner, so it stands at the scan."""
    return newest(entries.filter(~F.col("snap_id").isin([int(s) for s in dead])), key)


def compact_full(entries: DataFrame, key: Sequence[str]) -> DataFrame:
    """Newest entries, tombstones included, in key order: what a rewrite stores."""
    return newest(entries, key).repartitionByRange(*key, "snap_id").sortWithinPartitions(*key, "snap_id")


def gc_sweep(entries: DataFrame, key: Sequence[str], free: DataFrame | None, high_water: Column | int, extra: DataFrame | None = None) -> DataFrame:
    """block_nr of data blocks below high_water that no live extent of any snapshot, free list or other table holds."""
    spark = entries.sparkSession
    marked = newest(entries, key).filter(F.col("kind") == LIVE).select(F.col("data_block").alias("block_nr"))
    for other in (free, extra):
        if other is not None:
            marked = marked.union(other.select("block_nr"))
    return spark.range(FIRST_DATA_BLOCK, int(high_water)).select(F.col("id").alias("block_nr")).join(marked, "block_nr", "left_anti")


def orphan_workitems(work: DataFrame, snapshots: DataFrame) -> DataFrame:
    return work.join(snapshots.select("snap_id"), "snap_id", "left_anti")


def dropped(entries: DataFrame, key: Sequence[str], dead: Sequence[int]) -> DataFrame:
    """(whiteouts, keys): the newest entries that compact_whiteouts and drop_snapshot_keys take away, in one pass."""
    at = F.col("snap_id").isin([int(s) for s in dead])
    count = lambda what, name: F.count(F.when(what, 1)).alias(name)
    return newest(entries, key).agg(count(at & (F.col("kind") == WHITEOUT), "whiteouts"), count(at, "keys"))


def reclaim(extents: DataFrame, work: DataFrame, snapshots: DataFrame, budget: int) -> DataFrame:
    """The operations of one bounded slice over deferred deletes, in order.

    Work items (ino, snap_id, next_offset) go in (ino, snap_id) order. One whose snapshot is gone is dropped, at a
    cost of 1. Else each of its visible extents from next_offset on is deleted, at 1 each (its block is freed if the
    item's own snapshot holds it), and then the item is dropped, at 1. Returned: place (from 1), ino, snap_id, op
    ('extent', 'drop', 'orphan'), off, frees, issued: the first operation beyond the budget is there too, not issued.
    """
    spark = extents.sparkSession
    # Each item costs 1 at least, so no more than budget + 1 of them are looked at, their files' extents and their chains.
    alive = snapshots.select("snap_id", F.lit(True).alias("alive"))
    first = work.orderBy("ino", "snap_id").limit(int(budget) + 1).join(alive, "snap_id", "left").select("ino", "snap_id", "next_offset", "alive").collect()
    items = F.broadcast(spark.createDataFrame(first, "ino long, snap_id long, next_offset long, alive boolean"))
    lines = chains(snapshots, sorted({r.snap_id for r in first if r.alive}))
    up = F.broadcast(spark.createDataFrame([(head, at) for head, line in lines.items() for at in line], "snap_id long, at long"))
    asked = extents.join(F.broadcast(items.select("ino").distinct()), "ino", "left_semi")
    versions = newest(asked.select("ino", "off", "snap_id", "kind", "seq"), ["ino", "off"]).select("ino", "off", F.col("snap_id").alias("at"), "kind")
    # Each item reads through its own chain: the closest version of each (item, offset) decides.
    seen = versions.join(items.filter("alive"), "ino").filter("off >= next_offset").join(up, ["snap_id", "at"])
    best = seen.groupBy("ino", "snap_id", "off").agg(F.min("at").alias("at"), F.min_by("kind", "at").alias("kind")).filter(F.col("kind") == LIVE)
    rows = best.select("ino", "snap_id", F.lit("extent").alias("op"), "off", (F.col("at") == F.col("snap_id")).alias("frees"), F.lit(0).alias("last"))
    ends = items.select("ino", "snap_id", F.when(F.col("alive").isNull(), "orphan").otherwise("drop").alias("op"), F.lit(None).cast("long").alias("off"), F.lit(False).alias("frees"), F.lit(1).alias("last"))
    # Only the first `budget` operations are needed in order, which is a distributed top-k.
    first = rows.unionByName(ends).orderBy("ino", "snap_id", "last", "off").limit(int(budget) + 1)
    place = F.row_number().over(Window.orderBy("ino", "snap_id", "last", "off"))
    return first.select(place.cast("long").alias("place"), "ino", "snap_id", "op", "off", "frees").withColumn("issued", F.col("place") <= int(budget))


def reclaim_progress(ops: DataFrame) -> DataFrame:
    """The new cursor of the item that a slice leaves with extents: its last deleted offset and one. An item whose
    extents all went, and only its drop did not fit, keeps its old cursor."""
    left = ops.filter(~F.col("issued") & (F.col("op") == "extent")).select("ino", "snap_id")
    return ops.filter("issued").join(left, ["ino", "snap_id"]).groupBy("ino", "snap_id").agg((F.max("off") + 1).alias("next_offset"))


def reclaim_headroom(next_seq: Column, checkpoint_seq: Column, pending: Column) -> Column:
    """How much a commit may reclaim beside its own operations."""
    left = F.greatest(F.lit(0), F.lit(JOURNAL_SOFT) - (next_seq - checkpoint_seq))
    return F.greatest(F.lit(0).cast("long"), left - (pending + COMMIT_FRAMES))


def free_list_chunks(free: DataFrame) -> DataFrame:
    """(chunk, place, block_nr): a list in chunks of FREE_PER_BLOCK numbers, in order of block_nr."""
    from palimpsest.operators.mutate import numbered

    placed = numbered(free.select("block_nr"), 0, ["block_nr"])
    return placed.select(F.floor(F.col("seq") / FREE_PER_BLOCK).alias("chunk"), (F.col("seq") % FREE_PER_BLOCK).alias("place"), "block_nr")


def statfs(high_water: DataFrame, free: DataFrame) -> DataFrame:
    """total_blocks (the highest number in use and one) and free_blocks."""
    return high_water.agg((F.max("block_nr") + 1).alias("total_blocks")).crossJoin(free.agg(F.count("*").alias("free_blocks")))


def alloc_blocks(free: DataFrame, requests: DataFrame, high_water: int, order: Sequence[str]) -> DataFrame:
    """requests with block_nr: the free list (place, block_nr) is taken from its end, then new blocks follow the highest."""
    from palimpsest.operators.mutate import numbered

    asked = numbered(requests, 1, order).withColumnRenamed("seq", "nth")
    n_free = free.agg(F.count("*").alias("n_free"))  # one row
    stack = numbered(free.select((-F.col("place")).alias("back"), "block_nr"), 1, ["back"]).select(F.col("seq").alias("nth"), "block_nr")
    met = asked.join(stack, "nth", "left").crossJoin(F.broadcast(n_free))
    return met.withColumn("block_nr", F.coalesce("block_nr", F.lit(int(high_water)) + F.col("nth") - F.col("n_free") - 1)).drop("nth", "n_free")


def freed_blocks(free: DataFrame, chain: DataFrame) -> DataFrame:
    """All blocks that hold no data: the free list's, and those that its chunks are written in."""
    return free.select("block_nr").union(chain.select("block_nr")).distinct()
