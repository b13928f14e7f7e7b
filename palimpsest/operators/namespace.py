"""The hierarchy: directory entries (parent_ino, name) -> target_ino, and inodes.

Listings are in the order of sortable bytes: name, then snapshot id, so that at the root snapshot "abc" comes
before its own beginning "ab".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.keys import MODE_DIR, MODE_FILE, MODE_LINK, MODE_TYPE, blocks_of, is_type, name_problem, sortable
from palimpsest.operators.mutate import numbered

DIR_FILE, DIR_DIR, DIR_LINK = 1, 2, 3
PERMISSIONS = 0o7777
#: Fixed value: bytes that a symbolic link's target may have.
TARGET_MAX = 4096


def name_order(name: Column, snap: Column) -> Column:
    return sortable(F.to_binary(name, F.lit("utf-8")), snap)


def list_dirents(dirents: DataFrame, parent: int) -> DataFrame:
    """Of visible entries those of a directory, with `place` in listing order."""
    own = dirents.filter(F.col("parent_ino") == parent)
    place = F.row_number().over(Window.partitionBy("parent_ino").orderBy(name_order(F.col("name"), F.col("snap_id"))))
    return own.withColumn("place", place.cast("long"))


def lookup(dirents: DataFrame, names: DataFrame | None) -> DataFrame:
    """(parent_ino, name) pairs with what they name; unknown ones are left out. None asks for all entries."""
    return dirents if names is None else dirents.join(names.select("parent_ino", "name").distinct(), ["parent_ino", "name"])


def lookup_attr(dirents: DataFrame, inodes: DataFrame, names: DataFrame | None) -> DataFrame:
    """Attributes of what the pairs name."""
    found = lookup(dirents, names).select("parent_ino", "name", F.col("target_ino").alias("ino"))
    return found.join(inodes, "ino").select("parent_ino", "name", "ino", "mode", "nlink", "size", blocks_of(F.col("size")).alias("blocks"))


def lookup_dots(inodes: DataFrame) -> DataFrame:
    """(parent_ino, name, target_ino): what "." and ".." name in each directory; the root is its own parent."""
    dirs = inodes.filter(is_type(F.col("mode"), MODE_DIR))
    up = F.when(F.col("parent_ino") == 0, F.col("ino")).otherwise(F.col("parent_ino"))
    both = F.explode(F.array(F.struct(F.lit(".").alias("name"), F.col("ino").alias("target_ino")), F.struct(F.lit("..").alias("name"), up.alias("target_ino"))))
    return dirs.select(F.col("ino").alias("parent_ino"), both.alias("d")).select("parent_ino", "d.*")


def attributes(inodes: DataFrame) -> DataFrame:
    """What a caller is told of an inode: type and permission bits apart, and the blocks of its size."""
    kind = F.when(is_type(F.col("mode"), MODE_DIR), DIR_DIR).when(is_type(F.col("mode"), MODE_LINK), DIR_LINK).otherwise(DIR_FILE)
    rest = [c for c in ("uid", "gid", "atime", "mtime", "ctime") if c in inodes.columns]
    return inodes.select("ino", kind.alias("file_kind"), F.col("mode").bitwiseAND(F.lit(PERMISSIONS)).alias("perm"), "nlink", "size", blocks_of(F.col("size")).alias("blocks"), *rest)


def dangling(dirents: DataFrame, inodes: DataFrame) -> DataFrame:
    """Entries whose inode is missing."""
    return dirents.join(inodes.select(F.col("ino").alias("target_ino")), "target_ino", "left_anti")


def readdir(dirents: DataFrame, inodes: DataFrame, ino: int) -> DataFrame:
    """(place, name, ino, file_kind): '.', '..', then the entries."""
    own = inodes.filter(F.col("ino") == ino).select("ino", "parent_ino")
    dot = own.select(F.lit(1).cast("long").alias("place"), F.lit(".").alias("name"), "ino", F.lit(DIR_DIR).alias("file_kind"))
    up = own.select(F.lit(2).cast("long").alias("place"), F.lit("..").alias("name"), F.when(F.col("parent_ino") == 0, F.col("ino")).otherwise(F.col("parent_ino")).alias("ino"), F.lit(DIR_DIR).alias("file_kind"))
    rest = list_dirents(dirents, ino).select((F.col("place") + 2).alias("place"), "name", F.col("target_ino").alias("ino"), "file_kind")
    return dot.unionByName(up).unionByName(rest)


def readdir_page(listing: DataFrame, offset: int, count: int) -> DataFrame:
    """What follows cookie `offset`: places are cookies."""
    return listing.filter((F.col("place") > offset) & (F.col("place") <= offset + count))


def dir_is_empty(dirents: DataFrame, inodes: DataFrame) -> DataFrame:
    """(ino, is_empty) of all directories."""
    used = dirents.select(F.col("parent_ino").alias("ino")).distinct().withColumn("used", F.lit(True))
    dirs = inodes.filter(is_type(F.col("mode"), MODE_DIR)).select("ino")
    return dirs.join(used, "ino", "left").select("ino", F.col("used").isNull().alias("is_empty"))


def nlink_audit(dirents: DataFrame, inodes: DataFrame) -> DataFrame:
    """Non-directories whose stored link count is not that of the entries that name them."""
    counted = dirents.groupBy(F.col("target_ino").alias("ino")).agg(F.count("*").alias("n_links"))
    files = inodes.filter(~is_type(F.col("mode"), MODE_DIR)).select("ino", "nlink")
    return files.join(counted, "ino", "left").select("ino", "nlink", F.coalesce("n_links", F.lit(0)).alias("n_links")).filter("nlink <> n_links")


def block_usage(dirents: DataFrame, inodes: DataFrame) -> DataFrame:
    """(ino, n_entries, n_blocks) of each directory's own entries."""
    sizes = inodes.select(F.col("ino").alias("target_ino"), blocks_of(F.col("size")).alias("b"))
    return dirents.join(sizes, "target_ino").groupBy(F.col("parent_ino").alias("ino")).agg(F.count("*").alias("n_entries"), F.sum("b").alias("n_blocks"))


def unlink_check(dirents: DataFrame, inodes: DataFrame, names: DataFrame) -> DataFrame:
    """(parent_ino, name, verdict) of removing names: an entry and its inode must be there, and be no directory."""
    asked = names.select("parent_ino", "name").distinct()
    met = asked.join(dirents.select("parent_ino", "name", "target_ino"), ["parent_ino", "name"], "left")
    met = met.join(inodes.select(F.col("ino").alias("target_ino"), "mode"), "target_ino", "left")
    verdict = F.when(F.col("mode").isNull(), "not found").when(is_type(F.col("mode"), MODE_DIR), "is a directory").otherwise("ok")
    return met.select("parent_ino", "name", verdict.alias("verdict"))


def unlink(dirents: DataFrame, inodes: DataFrame, names: DataFrame | None, snap: int) -> DataFrame:
    """The delta of removing the named non-directories, those that unlink_check lets (None: all entries): table, ino, parent_ino, name, snap_id, kind, nlink.

    The entry gets a tombstone: Deleted where the own snapshot holds it, else Whiteout. With the last link its inode
    goes too and a work item defers its extents; else its link count falls."""
    own = F.lit(int(snap)).cast("long")
    hit = lookup(dirents, names).withColumnRenamed("snap_id", "d_snap")
    nodes = inodes.filter(~is_type(F.col("mode"), MODE_DIR)).select(F.col("ino").alias("target_ino"), "nlink", F.col("snap_id").alias("i_snap"))
    hit = hit.join(nodes, "target_ino")
    tomb = lambda s: F.when(F.col(s) == own, 1).otherwise(2)
    entry = hit.select(F.lit("dirent").alias("table"), F.col("target_ino").alias("ino"), "parent_ino", "name", own.alias("snap_id"), tomb("d_snap").alias("kind"), F.lit(None).cast("long").alias("nlink"))
    per = hit.groupBy("target_ino", "i_snap").agg((F.max("nlink") - F.count("*")).alias("left"))
    last = F.col("left") <= 0
    none = [F.lit(None).cast("long").alias("parent_ino"), F.lit(None).cast("string").alias("name")]
    node = per.select(F.lit("inode").alias("table"), F.col("target_ino").alias("ino"), *none, own.alias("snap_id"), F.when(last, tomb("i_snap")).otherwise(0).alias("kind"), F.when(last, F.lit(None)).otherwise(F.col("left")).cast("long").alias("nlink"))
    work = per.filter(last).select(F.lit("deleted_inode").alias("table"), F.col("target_ino").alias("ino"), *none, own.alias("snap_id"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("nlink"))
    return entry.unionByName(node).unionByName(work)


def rename(dirents: DataFrame, moves: DataFrame, snap: int) -> DataFrame:
    """(parent_ino, name, new_parent, new_name) moves: a verdict each and, where it is ok, the two rows of the delta.

    The source must exist and the target not, even under the same name. Rows: verdict, parent_ino, name, kind,
    target_ino. A moved directory's inode gets its new parent by reparented()."""
    src = dirents.select("parent_ino", "name", "target_ino", "file_kind", F.col("snap_id").alias("d_snap"))
    dst = dirents.select(F.col("parent_ino").alias("new_parent"), F.col("name").alias("new_name"), F.lit(True).alias("taken"))
    out = moves.join(src, ["parent_ino", "name"], "left").join(dst, ["new_parent", "new_name"], "left")
    # Of several moves of one source, or to one target, the first in order is made: the others find it gone, or taken.
    order = ["parent_ino", "name", "new_parent", "new_name"]
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    out = out.withColumns({"of_source": nth("parent_ino", "name"), "of_target": nth("new_parent", "new_name")})
    verdict = F.when(F.col("target_ino").isNull() | (F.col("of_source") > 1), "not found").when(F.col("taken") | (F.col("of_target") > 1), "already exists").otherwise("ok")
    out = out.withColumn("verdict", verdict)
    own = F.lit(int(snap))
    gone = F.struct(F.col("parent_ino").alias("parent_ino"), F.col("name").alias("name"), F.when(F.col("verdict") != "ok", F.lit(None)).otherwise(F.when(F.col("d_snap") == own, 1).otherwise(2)).cast("int").alias("kind"), F.col("target_ino").alias("target_ino"))
    new = F.struct(F.col("new_parent").alias("parent_ino"), F.col("new_name").alias("name"), F.lit(0).alias("kind"), F.col("target_ino").alias("target_ino"))
    return out.select("verdict", F.explode(F.when(F.col("verdict") == "ok", F.array(gone, new)).otherwise(F.array(gone))).alias("r")).select("verdict", "r.*")


def reparented(inodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Inodes with the parent that (ino, new_parent) moves give them."""
    moved = inodes.join(moves.select("ino", "new_parent"), "ino", "left")
    return moved.withColumn("parent_ino", F.coalesce("new_parent", "parent_ino")).select(*inodes.columns)


# -- handlers: a batch of requests, each with a verdict, and the delta of those that are ok


def _first(by: list[str]) -> Column:
    """Whether a request is the first of the batch for its key."""
    return F.row_number().over(Window.partitionBy(*by).orderBy("req")) == 1


def _taken(requests: DataFrame, dirents: DataFrame) -> DataFrame:
    there = dirents.select("parent_ino", "name", F.lit(True).alias("there"))
    met = requests.join(there, ["parent_ino", "name"], "left")
    return met.withColumn("taken", F.coalesce("there", F.lit(False)) | ~_first(["parent_ino", "name"])).drop("there")


def make(dirents: DataFrame, requests: DataFrame, first_ino: int, now: int) -> DataFrame:
    """Create files, directories and symbolic links: requests (req, parent_ino, name, file_kind, mode, uid, gid, target).

    A row for each request: req, verdict and, where it is ok, its inode and entry: ino (from first_ino on, dense, in
    order of req), parent_ino, name, file_kind, mode, uid, gid, nlink, size, atime, mtime, ctime. A link's target is
    its bytes, to be written at offset 0."""
    size = F.when(F.col("file_kind") == DIR_LINK, F.coalesce(F.octet_length("target"), F.lit(0))).otherwise(0).cast("long")
    verdict = (
        F.when(name_problem(F.col("name")).isNotNull(), F.concat(F.lit("invalid: "), name_problem(F.col("name"))))
        .when(size > TARGET_MAX, "invalid: target too long")
        .when(F.col("taken"), "already exists")
        .otherwise("ok")
    )
    ruled = _taken(requests, dirents).withColumn("verdict", verdict)
    type_ = F.when(F.col("file_kind") == DIR_DIR, MODE_DIR).when(F.col("file_kind") == DIR_LINK, MODE_LINK).otherwise(MODE_FILE)
    perm = F.when(F.col("file_kind") == DIR_LINK, 0o777).otherwise(F.col("mode").bitwiseAND(F.lit(PERMISSIONS)))
    made = alloc_ino(ruled.filter("verdict = 'ok'"), first_ino, ["req"])
    stamp = F.lit(int(now)).cast("long")
    made = made.select("req", "verdict", "ino", "parent_ino", "name", "file_kind", type_.bitwiseOR(perm).alias("mode"), "uid", "gid", F.when(F.col("file_kind") == DIR_DIR, 2).otherwise(1).cast("long").alias("nlink"), size.alias("size"), stamp.alias("atime"), stamp.alias("mtime"), stamp.alias("ctime"))
    refused = ruled.filter("verdict <> 'ok'").select("req", "verdict", "parent_ino", "name", "file_kind")
    return made.unionByName(refused, allowMissingColumns=True)


def alloc_ino(rows: DataFrame, first_ino: int, order: list[str]) -> DataFrame:
    """rows with ino: dense from first_ino on, in order."""
    return numbered(rows, int(first_ino), order).withColumnRenamed("seq", "ino")


def link(dirents: DataFrame, inodes: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """Further names of files: requests (req, ino, parent_ino, name). Rows: req, verdict, ino, parent_ino, name,
    file_kind, nlink (after all that are ok), ctime."""
    met = _taken(requests, dirents).join(inodes.select("ino", "mode", F.col("nlink").alias("had")), "ino", "left")
    verdict = (
        F.when(name_problem(F.col("name")).isNotNull(), F.concat(F.lit("invalid: "), name_problem(F.col("name"))))
        .when(F.col("mode").isNull(), "not found")
        .when(is_type(F.col("mode"), MODE_DIR), "not permitted")
        .when(F.col("taken"), "already exists")
        .otherwise("ok")
    )
    ruled = met.withColumn("verdict", verdict)
    more = ruled.filter("verdict = 'ok'").groupBy("ino").agg(F.count("*").alias("more"))
    ok = F.col("verdict") == "ok"
    kind = F.when(is_type(F.col("mode"), MODE_LINK), DIR_LINK).otherwise(DIR_FILE)
    out = ruled.join(more, "ino", "left")
    return out.select("req", "verdict", "ino", "parent_ino", "name", F.when(ok, kind).alias("file_kind"), F.when(ok, F.col("had") + F.col("more")).alias("nlink"), F.when(ok, F.lit(int(now))).cast("long").alias("ctime"))


def setattr(inodes: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """New attributes: changes (ino, mode, uid, gid, size, atime, mtime), null where nothing changes; one row for each ino.
    Rows: ino, verdict, the attributes, and `shrinks`, where extents are to be truncated to the new size. The type
    of a file stays; a larger size alone moves no data."""
    told = lambda c: F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c)
    new = changes.select("ino", *[F.col(c).alias(f"new_{c}") for c in ("mode", "uid", "gid", "size", "atime", "mtime")])
    met = new.join(inodes.withColumn("known", F.lit(True)), "ino", "left")
    perm = F.col("mode").bitwiseAND(F.lit(MODE_TYPE)).bitwiseOR(F.col("new_mode").bitwiseAND(F.lit(PERMISSIONS)))
    mode = F.when(F.col("new_mode").isNotNull(), perm).otherwise(F.col("mode"))
    met = met.filter("known").select(
        "ino", F.lit("ok").alias("verdict"), mode.alias("mode"), *[told(c) for c in ("uid", "gid", "size", "atime", "mtime")],
        F.lit(int(now)).cast("long").alias("ctime"), F.coalesce(F.col("new_size") < F.col("size"), F.lit(False)).alias("shrinks"),
    ).unionByName(met.filter("known IS NULL").select("ino", F.lit("not found").alias("verdict")), allowMissingColumns=True)
    return met


def rmdir(dirents: DataFrame, inodes: DataFrame, names: DataFrame, snap: int) -> DataFrame:
    """Remove empty directories: rows (verdict, parent_ino, name, ino, dirent_kind, inode_kind), the kinds of the two
    tombstones where the verdict is ok."""
    asked = names.select("parent_ino", "name").distinct()
    found = dirents.select("parent_ino", "name", F.col("target_ino").alias("ino"), "file_kind", F.col("snap_id").alias("d_snap"))
    used = dirents.select(F.col("parent_ino").alias("ino")).distinct().withColumn("used", F.lit(True))
    met = asked.join(found, ["parent_ino", "name"], "left").join(used, "ino", "left").join(inodes.select("ino", F.col("snap_id").alias("i_snap")), "ino", "left")
    verdict = F.when(F.col("ino").isNull(), "not found").when(F.col("file_kind") != DIR_DIR, "not a directory").when(F.col("used"), "not empty").otherwise("ok")
    met = met.withColumn("verdict", verdict)
    tomb = lambda c: F.when((F.col("verdict") == "ok") & F.col(c).isNotNull(), F.when(F.col(c) == int(snap), 1).otherwise(2))
    return met.select("verdict", "parent_ino", "name", "ino", tomb("d_snap").alias("dirent_kind"), tomb("i_snap").alias("inode_kind"))


def readlink(inodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(ino, verdict, start, count): the read that brings each link's target."""
    met = asked.select("ino").distinct().join(inodes.select("ino", "mode", "size"), "ino", "left")
    verdict = F.when(F.col("mode").isNull(), "not found").when(~is_type(F.col("mode"), MODE_LINK), "invalid").otherwise("ok")
    return met.select("ino", verdict.alias("verdict"), F.lit(0).cast("long").alias("start"), F.when(verdict == "ok", F.col("size")).alias("count"))


def written(inodes: DataFrame, writes: DataFrame, now: int) -> DataFrame:
    """(ino, size, mtime, ctime) after writes (ino, start, n): a size never falls by writing."""
    end = writes.groupBy("ino").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    stamp = F.lit(int(now)).cast("long")
    return inodes.select("ino", "size").join(end, "ino").select("ino", F.greatest("size", "end").alias("size"), stamp.alias("mtime"), stamp.alias("ctime"))
