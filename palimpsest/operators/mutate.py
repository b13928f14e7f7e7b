"""Mutators: each returns a delta, rows in entry schema that are appended to the state.

The state is always the newest of base and deltas. A batch holds at most one operation for each (key,
snap_id); it is resolved against the state before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.keys import DELETED, LIVE, WHITEOUT
from palimpsest.operators.errors import Invalid
from palimpsest.operators.visible import newest, visible


def _fixed(rows: DataFrame) -> DataFrame:
    """The same rows, whose partitions are as they are now: of one shuffle, which every pass reads.

    In a plan that reads them twice a shuffle by range may be there twice. Each then draws bounds of its own, and is
    joined to fewer partitions by its own sizes, so a row's partition and place in one are not those in the other.
    """
    spark = rows.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(rows._jdf.javaRDD(), rows._jdf.schema()), spark)


def numbered(rows: DataFrame, first_seq: int, order: Sequence[str]) -> DataFrame:
    """seq from first_seq on, dense, in order, nulls last. The rows are one batch's, and are dealt out by range as this
    is called; partitions are numbered apart and shifted."""
    by = [F.col(c).asc_nulls_last() for c in order]
    own = _fixed(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    own = own.withColumn("__part", part).withColumn("__place", place)
    sizes = own.groupBy("__part").agg(F.count("*").alias("n"))  # as many rows as partitions
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return own.join(F.broadcast(sizes), "__part").withColumn("seq", F.col("__before") + F.col("__place") + first_seq).drop("__at", "__part", "__place", "__before")


def checked_batch(batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """The batch, or Invalid if it holds two operations for one (key, snap_id)."""
    if batch.groupBy(*key, "snap_id").count().filter("count > 1").limit(1).count():
        raise Invalid("a batch may hold one operation for each key and snapshot")
    return batch


def upsert(entries: DataFrame, puts: DataFrame, key: Sequence[str]) -> DataFrame:
    """The state after puts (entry rows, whose seq is above all others'); a put on a tombstone revives it."""
    return newest(entries.unionByName(puts), key)


def delete_resolve(entries: DataFrame, targets: DataFrame, key: Sequence[str], chain: Sequence[int]) -> DataFrame:
    """What deleting each target key does: nothing if it isn't visible; at the own snapshot the entry becomes
    Deleted; one that an ancestor holds is covered by a Whiteout at the own snapshot."""
    own = int(chain[0])
    seen = visible(entries, key, chain).select(*key, F.col("snap_id").alias("visible_snap"))
    out = targets.select(*key).distinct().join(seen, list(key), "left")
    kind = F.when(F.col("visible_snap") == own, DELETED).when(F.col("visible_snap").isNotNull(), WHITEOUT)
    return out.select(*key, F.lit(own).cast("long").alias("snap_id"), kind.alias("kind"), F.col("visible_snap").isNotNull().alias("deleted"))


def delete_delta(entries: DataFrame, targets: DataFrame, key: Sequence[str], chain: Sequence[int], first_seq: int) -> DataFrame:
    """The tombstones of delete_resolve, as entries without a value."""
    found = numbered(delete_resolve(entries, targets, key, chain).filter("deleted").drop("deleted"), first_seq, key)
    none = [F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in entries.columns if c not in (*key, "snap_id", "kind", "seq")]
    return found.select(*key, "snap_id", "kind", "seq", *none).select(*entries.columns)


def put(rows: DataFrame, snap: int, first_seq: int, key: Sequence[str]) -> DataFrame:
    """Rows of keys and values as live entries at a snapshot."""
    return numbered(rows.withColumn("snap_id", F.lit(int(snap)).cast("long")).withColumn("kind", F.lit(LIVE)), first_seq, key)
