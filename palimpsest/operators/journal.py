"""The append-only log: frames (seq, is_commit, valid, ...) in groups that a commit frame closes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.visible import newest

#: Fixed value: frames of the ring.
RING = 1024


def running(frames: DataFrame, value: Column, merge=F.sum, alias: str = "run", through: int = 0) -> DataFrame:
    """A running sum (or max) in seq order, through the row itself or, with through=-1, the one before it.

    No window over the whole log: runs of RING frames are merged to a row each, and those again, so that a millionth
    of the log is run through in order; each frame adds its own run's part.
    """
    lot = F.floor(F.col("seq") / RING)
    rows = frames.withColumn("__lot", lot).withColumn("__v", value)
    # The same again: runs of RING rows are merged to a row each, so even a log of RING cubed frames ends in RING rows.
    lots = rows.groupBy("__lot").agg(merge("__v").alias("__t")).withColumn("__high", F.floor(F.col("__lot") / RING))
    highs = lots.groupBy("__high").agg(merge("__t").alias("__h"))
    zero = F.lit(0).cast("long")
    earlier = lambda by: Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    highs = highs.select("__high", F.coalesce(merge("__h").over(earlier("__high")), zero).alias("__far"))
    near = Window.partitionBy("__high").orderBy("__lot").rowsBetween(Window.unboundedPreceding, -1)
    both = lambda a, b: F.col(a) + F.col(b) if merge is F.sum else F.greatest(a, b)
    lots = lots.withColumn("__near", F.coalesce(merge("__t").over(near), zero)).join(F.broadcast(highs), "__high").select("__lot", both("__far", "__near").alias("__before"))
    within = Window.partitionBy("__lot").orderBy("seq").rowsBetween(Window.unboundedPreceding, through)
    own = F.coalesce(merge("__v").over(within), zero)
    return rows.withColumn("__own", own).join(lots, "__lot").withColumn(alias, both("__before", "__own")).drop("__lot", "__v", "__own", "__before")


def ring_slots(frames: DataFrame) -> DataFrame:
    """What the ring holds: of each slot the frame of the highest seq."""
    rest = [c for c in frames.columns if c != "slot"]
    return frames.groupBy(F.pmod("seq", F.lit(RING)).alias("slot")).agg(F.max_by(F.struct(*rest), "seq").alias("f")).select("slot", "f.*")


def valid_prefix(frames: DataFrame, start: int) -> DataFrame:
    """Frames from start on, up to the first invalid or missing one, a ring's worth at most."""
    window = frames.filter((F.col("seq") >= start) & (F.col("seq") < start + RING))
    bad = window.filter(~F.col("valid")).agg(F.min("seq").alias("stop"))
    out = window.crossJoin(F.broadcast(bad)).filter(F.col("stop").isNull() | (F.col("seq") < F.col("stop"))).drop("stop")
    # Without a gap, the frame at place i is start + i; the ring bounds this window to RING rows.
    place = F.row_number().over(Window.orderBy("seq")) - 1
    return out.withColumn("__i", place).filter(F.col("seq") == F.col("__i") + start).drop("__i")


def groups(frames: DataFrame) -> DataFrame:
    """Frames with group_id (commits before them) of complete groups only: a torn tail has no commit."""
    numbered = running(frames, F.col("is_commit").cast("long"), alias="group_id", through=-1)
    closed = numbered.filter("is_commit").select("group_id")
    return numbered.join(closed, "group_id", "left_semi")


def next_seq(frames: DataFrame, start: int) -> DataFrame:
    """next_seq after the last commit, or start."""
    return frames.agg(F.coalesce(F.max(F.when(F.col("is_commit"), F.col("seq"))) + 1, F.lit(int(start))).cast("long").alias("next_seq"))


def commit(ops: DataFrame, next_seq: int, checkpoint_seq: int, order: Sequence[str]) -> tuple[DataFrame, int, bool]:
    """(frames, next_seq, due): the frames (seq, is_commit, valid, the ops' columns) of one group, a frame for each
    operation and then the one that commits it, and whether a checkpoint is due before, as the ring is near its end."""
    from palimpsest.operators.maintain import JOURNAL_SOFT
    from palimpsest.operators.mutate import numbered

    due = max(0, int(next_seq) - int(checkpoint_seq)) >= JOURNAL_SOFT
    rest = [c for c in ops.columns if c != "seq"]
    n = ops.count()
    frames = numbered(ops.select(*rest), int(next_seq), order).withColumns({"is_commit": F.lit(False), "valid": F.lit(True)})
    end = ops.sparkSession.sql(f"SELECT {int(next_seq) + n}L AS seq, true AS is_commit, true AS valid")
    return frames.select("seq", "is_commit", "valid", *rest).unionByName(end, allowMissingColumns=True), int(next_seq) + n + 1, due


def replay(entries: DataFrame, frames: DataFrame, start: int, key: Sequence[str]) -> DataFrame:
    """The state after the complete groups of the valid prefix; replaying again changes nothing."""
    ops = groups(valid_prefix(frames, start)).filter(~F.col("is_commit")).select(*entries.columns)
    return newest(entries.unionByName(ops), key)
