"""Versioned tables derived from plain ones (events, orders, documents, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.keys import ROOT_SNAP

#: The tree after three snapshots of subvolume 1.
SNAPSHOTS = [(ROOT_SNAP, 0, 0), (4294967294, ROOT_SNAP, 0), (4294967293, ROOT_SNAP, 1), (4294967292, 4294967294, 0), (4294967291, 4294967294, 1), (4294967290, 4294967292, 0), (4294967289, 4294967292, 1)]
SUBVOLS = [(1, 4294967290, 0, 0), (2, 4294967293, 1, 1), (3, 4294967291, 1, 1), (4, 4294967289, 1, 1)]


def _values(spark: SparkSession, rows: list[tuple[int, ...]], columns: str, ints: int) -> DataFrame:
    text = ", ".join("(" + ", ".join(f"{v}" if i == ints else f"{v}L" for i, v in enumerate(r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({columns})")


def snapshots(spark: SparkSession) -> DataFrame:
    return _values(spark, SNAPSHOTS, "snap_id, parent_id, flags", 2)


def subvols(spark: SparkSession) -> DataFrame:
    return _values(spark, SUBVOLS, "subvol_id, snap_id, flags, parent_subvol", 2)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def extents(spark: SparkSession, folder: str) -> DataFrame:
    """Extent versions: ino, off, snap_id, kind, seq, data_block, len."""
    return _events(spark, folder, [])


def _events(spark: SparkSession, folder: str, more: list) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 2).otherwise(0)
    return read(spark, folder, "events").select(
        F.col("user_id").alias("ino"), (k % 10 * 4096).alias("off"), (F.lit(ROOT_SNAP) - F.col("event_id") % 7).alias("snap_id"),
        kind.alias("kind"), F.col("event_id").alias("seq"), (F.col("event_id") + 65).alias("data_block"), (F.col("event_id") % 4096 + 1).alias("len"), *more,
    )


def frames(spark: SparkSession, folder: str, invalid: int = 777) -> DataFrame:
    """The same versions as a log: purchases are commits, one frame is invalid."""
    return _events(spark, folder, [(F.col("event_type") == "purchase").alias("is_commit"), (F.col("event_id") != invalid).alias("valid")])


def inodes(spark: SparkSession, folder: str) -> DataFrame:
    """root > regions > nations > customers > orders: ino, mode, nlink, size, parent_ino, snap_id."""
    of = lambda t: read(spark, folder, t)
    long = lambda c: F.col(c).cast("long")
    zero = F.lit(0).cast("long")
    dirs = spark.sql("SELECT 1L AS ino, 0L AS parent_ino")
    dirs = dirs.union(of("region").select(long("r_regionkey") + 10, F.lit(1).cast("long")))
    dirs = dirs.union(of("nation").select(long("n_nationkey") + 100, long("n_regionkey") + 10))
    dirs = dirs.union(of("customer").select(long("c_custkey") + 1000, long("c_nationkey") + 100))
    both = dirs.select("ino", F.lit(16877).alias("mode"), F.lit(2).cast("long").alias("nlink"), zero.alias("size"), "parent_ino")
    links = F.when(F.col("o_orderkey") % 10 == 3, 2).otherwise(1).cast("long")
    files = of("orders").select((F.col("o_orderkey") + 10_000_000).alias("ino"), F.lit(33188).alias("mode"), links.alias("nlink"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size"), (F.col("o_custkey") + 1000).alias("parent_ino"))
    return both.union(files).withColumn("snap_id", F.lit(ROOT_SNAP))


def inode_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of inodes: all at the root snapshot; those of pending orders are covered by whiteouts at the head."""
    base = inodes(spark, folder).withColumns({"kind": F.lit(0), "seq": F.lit(1).cast("long")})
    pending = read(spark, folder, "orders").filter("o_orderstatus = 'P'").select((F.col("o_orderkey") + 10_000_000).alias("ino"))
    gone = base.join(pending, "ino", "left_semi").withColumns({"snap_id": F.lit(4294967290), "kind": F.lit(2), "seq": F.lit(2).cast("long")})
    return base.unionByName(gone)


def deep_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """A tree from the data, deeper than a hundred levels: a snapshot for each customer, below that of the one before it
    or, for every fiftieth, of half its key. Customer 0 is the root snapshot."""
    key = F.col("c_custkey").cast("long")
    above = F.when(key % 50 == 0, F.floor(key / 2)).otherwise(key - 1).cast("long")
    parent = F.when(key == 0, F.lit(0).cast("long")).otherwise(F.lit(ROOT_SNAP) - above)
    return read(spark, folder, "customer").select((F.lit(ROOT_SNAP) - key).alias("snap_id"), parent.alias("parent_id"), (key % 2).cast("int").alias("flags"))


def deep_subvols(spark: SparkSession, folder: str) -> DataFrame:
    """A subvolume for each supplier, whose head is one of the tree's first 140 snapshots."""
    key = F.col("s_suppkey").cast("long")
    parent = F.when(key == 0, F.lit(0).cast("long")).otherwise(F.floor(key / 4) + 1)
    return read(spark, folder, "supplier").select((key + 1).alias("subvol_id"), (F.lit(ROOT_SNAP) - key * 13 % 140).alias("snap_id"), (key % 3 % 2).cast("int").alias("flags"), parent.alias("parent_subvol"))


def dirents(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of directory entries: all at the root snapshot; pending orders are covered by whiteouts at the head."""
    of = lambda t: read(spark, folder, t)
    long = lambda c: F.col(c).cast("long")
    row = lambda df, parent, name, target, kind: df.select(parent.alias("parent_ino"), name.alias("name"), target.alias("target_ino"), F.lit(kind).alias("file_kind"))
    base = row(of("region"), F.lit(1).cast("long"), F.col("r_name"), long("r_regionkey") + 10, 2)
    base = base.union(row(of("nation"), long("n_regionkey") + 10, F.col("n_name"), long("n_nationkey") + 100, 2))
    base = base.union(row(of("customer"), long("c_nationkey") + 100, F.col("c_name"), long("c_custkey") + 1000, 2))
    orders = of("orders")
    order = lambda df: row(df, F.col("o_custkey") + 1000, F.col("o_orderkey").cast("string"), F.col("o_orderkey") + 10_000_000, 1)
    base = base.union(order(orders)).select("*", F.lit(ROOT_SNAP).alias("snap_id"), F.lit(0).alias("kind"), F.lit(1).cast("long").alias("seq"))
    gone = order(orders.filter("o_orderstatus = 'P'")).select("*", F.lit(4294967290).alias("snap_id"), F.lit(2).alias("kind"), F.lit(2).cast("long").alias("seq"))
    return base.union(gone)


def work_items(spark: SparkSession, folder: str) -> DataFrame:
    """Deferred deletes: every third file of the extents at one of four snapshots, one of which is gone."""
    own = extents(spark, folder).select("ino").distinct().filter("ino % 3 = 0")
    snap = F.element_at(F.array(*[F.lit(s) for s in (ROOT_SNAP, 4294967290, 4294967294, 4294967280)]), (F.col("ino") % 4 + 1).cast("int"))
    return own.select("ino", snap.alias("snap_id"), (F.col("ino") % 2 * 4097).alias("next_offset"))


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """Files of bytes: ino, start, data."""
    return read(spark, folder, "documents").select(F.col("doc_id").alias("ino"), (F.col("doc_id") % 5 * 1000).alias("start"), F.encode("text", "utf-8").alias("data"))
