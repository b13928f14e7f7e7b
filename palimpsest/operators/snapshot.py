"""Snapshots and subvolumes (branch heads): four-row deltas, whatever the size of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.keys import READONLY, ROOT_SNAP, has_flag
from palimpsest.operators.chain import below, reached
from palimpsest.operators.errors import Busy, Exhausted, Invalid, NotFound


def get_snapshot(snapshots: DataFrame, snap: int) -> DataFrame:
    """The metadata of one snapshot, which stands at the root snapshot and so has one version; no row if unknown."""
    return snapshots.filter(F.col("snap_id") == int(snap))


def get_subvol(subvols: DataFrame, subvol: int) -> DataFrame:
    return subvols.filter(F.col("subvol_id") == int(subvol))


def list_subvols(subvols: DataFrame) -> DataFrame:
    return subvols.orderBy("subvol_id")


def switch_subvol(subvols: DataFrame, subvol: int) -> int:
    """The head of the subvolume that is read and written from now on."""
    head = get_subvol(subvols, subvol).select("snap_id").first()
    if head is None:
        raise NotFound(f"subvolume {subvol}")
    return int(head.snap_id)


def seed(spark) -> tuple[DataFrame, DataFrame]:
    """(snapshots, subvols) of a new store: the root snapshot and the subvolume that heads it."""
    roots = spark.sql(f"SELECT {ROOT_SNAP}L AS snap_id, 0L AS parent_id, 0 AS flags")
    return roots, spark.sql(f"SELECT 1L AS subvol_id, {ROOT_SNAP}L AS snap_id, 0 AS flags, 0L AS parent_subvol")


def create(snapshots: DataFrame, subvols: DataFrame, source: int) -> tuple[DataFrame, DataFrame]:
    """(snapshots, subvols) after a snapshot of subvolume `source`: its head moves to a new writable child, and
    a new read-only subvolume heads a second child, of the next smaller id."""
    spark = snapshots.sparkSession
    head = subvols.filter(F.col("subvol_id") == source).select("snap_id").first()
    if head is None:
        raise NotFound(f"subvolume {source}")
    low, high = snapshots.agg(F.min("snap_id")).first()[0], subvols.agg(F.max("subvol_id")).first()[0]
    if low <= 2 or high >= 0xFFFFFFFF:
        raise Exhausted("no ids are left")
    new = spark.sql(f"SELECT * FROM VALUES ({low - 1}L, {head.snap_id}L, 0), ({low - 2}L, {head.snap_id}L, {READONLY}) AS t(snap_id, parent_id, flags)")
    own = spark.sql(f"SELECT {high + 1}L AS subvol_id, {low - 2}L AS snap_id, {READONLY} AS flags, {source}L AS parent_subvol")
    moved = subvols.withColumn("snap_id", F.when(F.col("subvol_id") == source, F.lit(low - 1)).otherwise(F.col("snap_id")).cast("long"))
    return snapshots.unionByName(new), moved.unionByName(own, allowMissingColumns=True)


def busy(snapshots: DataFrame, subvols: DataFrame) -> DataFrame:
    """Why each subvolume's snapshot can't go: a child snapshot, a child subvolume, or another head below it."""
    heads = subvols.select("subvol_id", "snap_id")
    child = snapshots.select(F.col("parent_id").alias("snap_id")).distinct().withColumn("has_child", F.lit(True))
    nested = subvols.filter("parent_subvol <> 0").select(F.col("parent_subvol").alias("subvol_id")).distinct().withColumn("has_subvol", F.lit(True))
    # A subvolume has a reader if more heads than its own stand at its snapshot or below it.
    n_below = below(snapshots, heads.select("snap_id", F.lit(1).cast("long").alias("n")))
    below_ = heads.join(n_below, "snap_id").select("subvol_id", (F.col("n") > 1).alias("has_reader"))
    no = F.lit(False)
    out = heads.join(child, "snap_id", "left").join(nested, "subvol_id", "left").join(below_, "subvol_id", "left")
    return out.select("subvol_id", "snap_id", F.coalesce("has_child", no).alias("has_child"), (F.coalesce("has_subvol", no) | F.coalesce("has_reader", no)).alias("has_dependent"))


def delete_check(snapshots: DataFrame, subvols: DataFrame, active: int, targets: DataFrame) -> DataFrame:
    """(subvol_id, verdict) for each subvolume asked to be deleted; the first reason that holds."""
    known = subvols.join(busy(snapshots, subvols).drop("snap_id"), "subvol_id").withColumn("known", F.lit(True))
    out = targets.select("subvol_id").join(known, "subvol_id", "left")
    verdict = (
        F.when(F.col("subvol_id") == 1, "invalid: root")
        .when(F.col("known").isNull(), "not found")
        .when(~has_flag(F.col("flags"), READONLY), "invalid: writable")
        .when(F.col("subvol_id") == active, "busy: active")
        .when(F.col("snap_id") == ROOT_SNAP, "invalid: root snapshot")
        .when(F.col("has_child"), "busy: child")
        .when(F.col("has_dependent"), "busy: dependent")
        .otherwise("ok")
    )
    return out.select("subvol_id", verdict.alias("verdict"))


def unreferenced(snapshots: DataFrame, subvols: DataFrame) -> DataFrame:
    """Snapshots that are on no subvolume's chain. This is where taking away leaves without a head, again and
    again, ends: what has a head below it never becomes such a leaf, all else does."""
    used = reached(snapshots, subvols)
    return snapshots.filter(F.col("snap_id") != ROOT_SNAP).join(used, "snap_id", "left_anti")


_REFUSED = {"not found": NotFound, "invalid": Invalid, "busy": Busy}


def delete(snapshots: DataFrame, subvols: DataFrame, active: int, subvol: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """(snapshots, subvols, dead snapshot ids) after a delete, whose keys are then dropped (drop_snapshot_keys).
    Refused with what delete_check says."""
    target = snapshots.sparkSession.sql(f"SELECT {int(subvol)}L AS subvol_id")
    verdict = delete_check(snapshots, subvols, active, target).first().verdict
    if verdict != "ok":
        raise _REFUSED[verdict.split(":")[0]](f"subvolume {subvol}: {verdict}")
    dead = [r.snap_id for r in subvols.filter(F.col("subvol_id") == subvol).select("snap_id").collect()]
    left, heads = snapshots.filter(~F.col("snap_id").isin(dead)), subvols.filter(F.col("subvol_id") != subvol)
    swept = [r.snap_id for r in unreferenced(left, heads).select("snap_id").collect()]
    return left.filter(~F.col("snap_id").isin(swept)), heads, [*dead, *swept]
