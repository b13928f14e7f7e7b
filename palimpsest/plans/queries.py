"""Named queries over the adapters' tables, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import keys as K
from palimpsest.operators import chain as C
from palimpsest.operators import files as X
from palimpsest.operators import journal as J
from palimpsest.operators import maintain as M
from palimpsest.operators import mutate as U
from palimpsest.operators import namespace as N
from palimpsest.operators import snapshot as S
from palimpsest.operators import visible as V
from palimpsest.sources import adapters as A

KEY = ["ino", "off"]
NAME = ["parent_ino", "name"]
ROOT, HEAD, MIDDLE, SIDE = K.ROOT_SNAP, 4294967290, 4294967294, 4294967293
#: A slice of deferred work, and the file and the directories that single look-ups ask for.
BUDGET, FILE, NATION, CUSTOMER = 128, 7, 103, 1010
#: The second that requests are made in, and the first inode that they may get.
NOW, FIRST_INO = 1_700_000_000, 20_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _rows(values: list[tuple[int, ...]], columns: str, ints: int) -> str:
    text = ", ".join("(" + ", ".join(f"{v}" if i == ints else f"{v}::BIGINT" for i, v in enumerate(r)) + ")" for r in values)
    return f"(SELECT * FROM (VALUES {text}) t({columns}))"


_BASE = f"""
WITH RECURSIVE snaps AS {_rows(A.SNAPSHOTS, "snap_id, parent_id, flags", 2)},
subvols AS {_rows(A.SUBVOLS, "subvol_id, snap_id, flags, parent_subvol", 2)},
up(start, snap_id, depth) AS (
  SELECT snap_id, snap_id, 0 FROM snaps UNION ALL
  SELECT up.start, s.parent_id, up.depth + 1 FROM up JOIN snaps s ON s.snap_id = up.snap_id WHERE s.parent_id <> 0),
e AS (
  SELECT user_id AS ino, CAST(json_extract(props, '$.k') AS BIGINT) % 10 * 4096 AS off, 4294967295 - event_id % 7 AS snap_id,
    CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 2 ELSE 0 END AS kind, event_id AS seq, event_id + 65 AS data_block, event_id % 4096 + 1 AS len
  FROM events),
m AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY ino, off, snap_id ORDER BY seq DESC) = 1),
head AS (SELECT snap_id FROM up WHERE start = {HEAD}),
vis AS (SELECT * FROM (SELECT * FROM m WHERE snap_id IN (SELECT snap_id FROM head) QUALIFY row_number() OVER (PARTITION BY ino, off ORDER BY snap_id) = 1) WHERE kind = 0),
root AS (SELECT * FROM m WHERE snap_id = {ROOT} AND kind = 0)"""

_TREE = f"""{_BASE},
ino AS (
  SELECT 1::BIGINT AS ino, 16877 AS mode, 2::BIGINT AS nlink, 0::BIGINT AS size, 0::BIGINT AS parent_ino
  UNION ALL SELECT r_regionkey::BIGINT + 10, 16877, 2, 0, 1 FROM region
  UNION ALL SELECT n_nationkey::BIGINT + 100, 16877, 2, 0, n_regionkey::BIGINT + 10 FROM nation
  UNION ALL SELECT c_custkey::BIGINT + 1000, 16877, 2, 0, c_nationkey::BIGINT + 100 FROM customer
  UNION ALL SELECT o_orderkey + 10000000, 33188, CASE WHEN o_orderkey % 10 = 3 THEN 2 ELSE 1 END, CAST(round(o_totalprice * 100) AS BIGINT), o_custkey + 1000 FROM orders),
dirent AS (
  SELECT 1::BIGINT AS parent_ino, r_name AS name, r_regionkey::BIGINT + 10 AS target_ino, 2 AS file_kind, {ROOT} AS snap_id FROM region
  UNION ALL SELECT n_regionkey::BIGINT + 10, n_name, n_nationkey::BIGINT + 100, 2, {ROOT} FROM nation
  UNION ALL SELECT c_nationkey::BIGINT + 100, c_name, c_custkey::BIGINT + 1000, 2, {ROOT} FROM customer
  UNION ALL SELECT o_custkey + 1000, CAST(o_orderkey AS VARCHAR), o_orderkey + 10000000, 1, {ROOT} FROM orders WHERE o_orderstatus <> 'P')"""

_LOG = f"""{_BASE},
f AS (SELECT event_id AS seq, event_type = 'purchase' AS is_commit, event_id <> 777 AS valid FROM events),
stop AS (SELECT coalesce(min(seq), 1000000000000) AS s FROM f WHERE NOT valid AND seq >= 0 AND seq < 1024),
pre AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i FROM f WHERE seq >= 0 AND seq < 1024 AND seq < (SELECT s FROM stop)) WHERE i = seq),
g AS (SELECT seq, is_commit, CAST(coalesce(sum(is_commit::BIGINT) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS group_id FROM {{src}}),
closed AS (SELECT * FROM g WHERE group_id IN (SELECT group_id FROM g WHERE is_commit))"""


def query(sql: str, base: str = _BASE):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"{base}\n{sql}"
        return f

    return add


def _chain(spark: SparkSession, head: int = HEAD) -> list[int]:
    return C.chain(A.snapshots(spark), head)


def _names(spark: SparkSession, d: str) -> DataFrame:
    return V.visible(A.dirents(spark, d), NAME, _chain(spark))


# -- look-ups


@query(f"SELECT ino, off, snap_id, kind, seq, data_block, len FROM m WHERE snap_id = {SIDE} AND kind = 0 AND off = 4096 AND ino <= 50")
def find_at(spark, d):
    return V.find_at(A.extents(spark, d), KEY, (F.col("off") == 4096) & (F.col("ino") <= 50), SIDE)


@query("SELECT ino, off, data_block, len FROM vis WHERE off = 8192 AND ino <= 50")
def find_visible(spark, d):
    asked = A.extents(spark, d).filter((F.col("off") == 8192) & (F.col("ino") <= 50))
    return V.visible(asked, KEY, _chain(spark)).select("ino", "off", "data_block", "len")


@query("SELECT ino, off, data_block, len, snap_id FROM vis WHERE off = 8192 AND ino <= 50")
def find_visible_with_snap(spark, d):
    asked = A.extents(spark, d).filter((F.col("off") == 8192) & (F.col("ino") <= 50))
    return V.visible(asked, KEY, _chain(spark)).select("ino", "off", "data_block", "len", "snap_id")


@query(f"SELECT ino, off, data_block, len FROM root WHERE ino = {FILE} AND off = 0")
def get_extent(spark, d):
    asked = A.extents(spark, d).filter((F.col("ino") == FILE) & (F.col("off") == 0))
    return V.visible(asked, KEY, [ROOT]).select("ino", "off", "data_block", "len")


@query(f"SELECT ino, mode, nlink, size, parent_ino FROM ino WHERE ino = {CUSTOMER}", _TREE)
def get_inode(spark, d):
    asked = A.inode_versions(spark, d).filter(F.col("ino") == CUSTOMER)
    return V.visible(asked, ["ino"], _chain(spark)).select("ino", "mode", "nlink", "size", "parent_ino")


@query("SELECT ino, mode, nlink, size, parent_ino FROM ino WHERE ino NOT IN (SELECT o_orderkey + 10000000 FROM orders WHERE o_orderstatus = 'P')", _TREE)
def list_inodes(spark, d):
    return V.visible(A.inode_versions(spark, d), ["ino"], _chain(spark)).select("ino", "mode", "nlink", "size", "parent_ino")


@query(f"SELECT parent_ino, name, target_ino, file_kind FROM dirent WHERE parent_ino = {NATION} AND name LIKE '%7'", _TREE)
def lookup_dirent(spark, d):
    asked = A.dirents(spark, d).filter((F.col("parent_ino") == NATION) & F.col("name").endswith("7")).select(*NAME)
    return N.lookup(_names(spark, d), asked).select("parent_ino", "name", "target_ino", "file_kind")


@query("SELECT parent_ino, name, target_ino AS ino, mode, nlink, size, CAST(ceil(size / 4096.0) AS BIGINT) AS blocks FROM dirent JOIN ino ON ino.ino = target_ino".replace("SELECT parent_ino", "SELECT dirent.parent_ino"), _TREE)
def lookup_attr(spark, d):
    return N.lookup_attr(_names(spark, d), A.inodes(spark, d).drop("parent_ino"), None)


# -- scans


@query("SELECT ino, off, snap_id, kind, seq, data_block, len FROM m")
def merge_runs(spark, d):
    e = A.extents(spark, d)
    return V.merge_runs([e.filter(f"seq % 4 = {i}") for i in range(4)], KEY)


@query("SELECT format('{:016X}{:016X}{:08X}', ino, off, snap_id) AS sk, ino, off, snap_id, kind, seq FROM m WHERE ino >= 10 AND ino < 40")
def range_scan_all(spark, d):
    logical = F.concat(K.be(F.col("ino"), 8), K.be(F.col("off"), 8))
    # The same range on the typed column, which the scan can use, and on the bytes, whose order it is.
    rows = A.extents(spark, d).filter("ino >= 10 AND ino < 40").withColumn("sk", K.sortable(logical, F.col("snap_id")))
    bound = lambda n: F.concat(K.be(F.lit(n), 8), K.be(F.lit(0), 8))
    rows = rows.filter(K.in_byte_range(F.col("sk"), bound(10), bound(40)))
    return V.newest(rows, KEY).select(F.hex("sk").alias("sk"), "ino", "off", "snap_id", "kind", "seq")


@query("SELECT ino, off, snap_id, data_block, len FROM m WHERE kind = 0 AND ino >= 10 AND ino < 40")
def range_scan_live(spark, d):
    return V.live(A.extents(spark, d).filter("ino >= 10 AND ino < 40"), KEY).select("ino", "off", "snap_id", "data_block", "len")


@query("SELECT ino, off, data_block, len FROM vis")
def range_scan_visible(spark, d):
    return V.visible(A.extents(spark, d), KEY, _chain(spark)).select("ino", "off", "data_block", "len")


@query("SELECT ino, off, snap_id, data_block, len FROM vis")
def range_scan_visible_with_snap(spark, d):
    return V.visible(A.extents(spark, d), KEY, _chain(spark)).select("ino", "off", "snap_id", "data_block", "len")


@query(f"SELECT off, data_block, len FROM vis WHERE ino = {FILE} ORDER BY off")
def list_extents(spark, d):
    return V.visible(A.extents(spark, d).filter(F.col("ino") == FILE), KEY, _chain(spark)).select("off", "data_block", "len").orderBy("off")


@query("SELECT ino, off, data_block, len FROM vis WHERE ino = 8 AND off >= 4096 AND off < 20481")
def extents_in_range(spark, d):
    found = X.extents_in_range(A.extents(spark, d), 8, 4096, 20481)
    return V.visible(found, KEY, _chain(spark)).select("ino", "off", "data_block", "len")


@query(f"SELECT name, target_ino, file_kind, row_number() OVER (ORDER BY encode(name) || unhex('FFFFFFFF')) AS place FROM dirent WHERE parent_ino = {NATION}", _TREE)
def list_dirents(spark, d):
    own = A.dirents(spark, d).filter(F.col("parent_ino") == NATION)
    return N.list_dirents(V.visible(own, NAME, _chain(spark)), NATION).select("name", "target_ino", "file_kind", "place")


_READDIR = f"""l AS (
  SELECT 1::BIGINT AS place, '.' AS name, ino, 2 AS file_kind FROM ino WHERE ino = {CUSTOMER}
  UNION ALL SELECT 2, '..', parent_ino, 2 FROM ino WHERE ino = {CUSTOMER}
  UNION ALL SELECT row_number() OVER (ORDER BY encode(name) || unhex('FFFFFFFF')) + 2, name, target_ino, file_kind FROM dirent WHERE parent_ino = {CUSTOMER})"""


@query("SELECT * FROM l", f"{_TREE},\n{_READDIR}")
def readdir(spark, d):
    own = A.dirents(spark, d).filter(F.col("parent_ino") == CUSTOMER)
    return N.readdir(V.visible(own, NAME, _chain(spark)), A.inodes(spark, d), CUSTOMER)


@query("SELECT * FROM l WHERE place > 3 AND place <= 8", f"{_TREE},\n{_READDIR}")
def readdir_page(spark, d):
    return N.readdir_page(readdir(spark, d), 3, 5)


@query("SELECT snap_id, parent_id, flags FROM snaps ORDER BY snap_id")
def list_snapshots(spark, d):
    return A.snapshots(spark).orderBy("snap_id")


@query("SELECT snap_id, kind, count(*) AS n_stored, (SELECT count(*) FROM m WHERE m.snap_id = e.snap_id AND m.kind = e.kind) AS n_newest FROM e GROUP BY snap_id, kind")
def version_counts(spark, d):
    return V.version_counts(A.extents(spark, d), KEY)


@query("SELECT ino, off, data_block, len, snap_id = 4294967290 AS own FROM vis")
def exclusive_extents(spark, d):
    return V.exclusive(A.extents(spark, d), KEY, _chain(spark)).select("ino", "off", "data_block", "len", "own")


@query("SELECT coalesce(a.ino, b.ino) AS ino, coalesce(a.off, b.off) AS off, a.data_block AS a_data_block, b.data_block AS b_data_block FROM vis a FULL JOIN root b ON a.ino = b.ino AND a.off = b.off WHERE a.data_block IS DISTINCT FROM b.data_block")
def view_diff(spark, d):
    e = A.extents(spark, d)
    return V.view_diff(e, KEY, _chain(spark), [ROOT], ["data_block"])


# -- the snapshot tree


@query("SELECT start, snap_id, depth FROM up")
def ancestor_chain(spark, d):
    return C.closure(A.snapshots(spark))


@query("SELECT a.snap_id AS ancestor, b.snap_id AS of, EXISTS (SELECT 1 FROM up WHERE start = b.snap_id AND up.snap_id = a.snap_id) AS is_ancestor FROM snaps a, snaps b".replace("AS of", 'AS "of"'))
def is_ancestor(spark, d):
    s = A.snapshots(spark)
    pairs = s.select(F.col("snap_id").alias("ancestor")).crossJoin(s.select(F.col("snap_id").alias("of")))
    return C.is_ancestor(s, pairs)


_BUSY = """b AS (SELECT subvol_id, snap_id, flags,
  EXISTS (SELECT 1 FROM snaps WHERE parent_id = v.snap_id) AS has_child,
  EXISTS (SELECT 1 FROM subvols o WHERE o.subvol_id <> v.subvol_id AND (o.parent_subvol = v.subvol_id OR v.snap_id IN (SELECT up.snap_id FROM up WHERE start = o.snap_id))) AS has_dependent
  FROM subvols v)"""


@query("SELECT subvol_id, snap_id, has_child, has_dependent FROM b", f"{_BASE},\n{_BUSY}")
def snapshot_busy(spark, d):
    return S.busy(A.snapshots(spark), A.subvols(spark))


@query(
    f"""SELECT t.subvol_id, CASE WHEN t.subvol_id = 1 THEN 'invalid: root' WHEN b.subvol_id IS NULL THEN 'not found' WHEN flags % 2 = 0 THEN 'invalid: writable'
  WHEN t.subvol_id = 2 THEN 'busy: active' WHEN snap_id = {ROOT} THEN 'invalid: root snapshot' WHEN has_child THEN 'busy: child' WHEN has_dependent THEN 'busy: dependent' ELSE 'ok' END AS verdict
  FROM (SELECT unnest(range(1, 8)) AS subvol_id) t LEFT JOIN b USING (subvol_id)""",
    f"{_BASE},\n{_BUSY}",
)
def snapshot_delete_check(spark, d):
    targets = spark.range(1, 8).select(F.col("id").alias("subvol_id"))
    return S.delete_check(A.snapshots(spark), A.subvols(spark), 2, targets)


@query(f"SELECT snap_id, parent_id, flags FROM snaps UNION ALL VALUES (4294967288, {HEAD}, 0), (4294967287, {HEAD}, 1)")
def snapshot_create(spark, d):
    return S.create(A.snapshots(spark), A.subvols(spark), 1)[0]


@query("SELECT snap_id, parent_id, flags FROM snaps WHERE snap_id IN (4294967291)")
def sweep_unreferenced(spark, d):
    # Without subvolume 3, nothing reads its snapshot.
    return S.unreferenced(A.snapshots(spark), A.subvols(spark).filter("subvol_id <> 3"))


# -- compaction and sweeps


@query("SELECT ino, off, snap_id, kind, seq FROM m")
def compact_full(spark, d):
    return M.compact_full(A.extents(spark, d), KEY).select("ino", "off", "snap_id", "kind", "seq")


@query(f"SELECT ino, off, snap_id, kind, seq FROM m WHERE NOT (kind = 2 AND snap_id IN ({SIDE}, {MIDDLE}))")
def compact_whiteouts(spark, d):
    return M.compact_whiteouts(A.extents(spark, d), KEY, [SIDE, MIDDLE]).select("ino", "off", "snap_id", "kind", "seq")


@query(f"SELECT ino, off, snap_id, kind, seq FROM m WHERE snap_id <> {SIDE}")
def drop_snapshot_keys(spark, d):
    return M.drop_snapshot_keys(A.extents(spark, d), KEY, [SIDE]).select("ino", "off", "snap_id", "kind", "seq")


@query("SELECT b AS block_nr FROM (SELECT unnest(range(65, (SELECT max(event_id) + 66 FROM events))) AS b) WHERE b NOT IN (SELECT data_block FROM m WHERE kind = 0) AND b % 10 <> 0")
def gc_sweep(spark, d):
    e = A.extents(spark, d)
    top = e.agg(F.max("data_block")).first()[0]
    free = spark.range(0, (top or 0) + 1, 10).select(F.col("id").alias("block_nr"))
    return M.gc_sweep(e, KEY, free, (top or 64) + 1)


_WORK = f"""work AS (SELECT ino, CASE ino % 4 WHEN 0 THEN {ROOT} WHEN 1 THEN {HEAD} WHEN 2 THEN {MIDDLE} ELSE 4294967280 END AS snap_id, ino % 2 * 4097 AS next_offset
  FROM (SELECT DISTINCT ino FROM e) WHERE ino % 3 = 0),
seen AS (SELECT w.ino, w.snap_id, m.off, m.kind, m.snap_id = w.snap_id AS frees FROM work w JOIN up ON up.start = w.snap_id JOIN m ON m.ino = w.ino AND m.snap_id = up.snap_id AND m.off >= next_offset
  QUALIFY row_number() OVER (PARTITION BY w.ino, w.snap_id, m.off ORDER BY m.snap_id) = 1),
ops AS (
  SELECT ino, snap_id, 'extent' AS op, off, frees, 0 AS last FROM seen WHERE kind = 0
  UNION ALL SELECT ino, snap_id, CASE WHEN snap_id IN (SELECT snap_id FROM snaps) THEN 'drop' ELSE 'orphan' END, NULL, false, 1 FROM work),
placed AS (SELECT row_number() OVER (ORDER BY ino, snap_id, last, off) AS place, * FROM ops)"""


@query("SELECT ino, snap_id, next_offset FROM work WHERE snap_id NOT IN (SELECT snap_id FROM snaps)", f"{_BASE},\n{_WORK}")
def orphan_workitems(spark, d):
    return M.orphan_workitems(A.work_items(spark, d), A.snapshots(spark)).select("ino", "snap_id", "next_offset")


def _reclaim(spark, d):
    return M.reclaim(A.extents(spark, d), A.work_items(spark, d), A.snapshots(spark), BUDGET)


@query(f"SELECT place, ino, snap_id, op, off, frees FROM placed WHERE place <= {BUDGET}", f"{_BASE},\n{_WORK}")
def reclaim_budget(spark, d):
    return _reclaim(spark, d).filter("issued").drop("issued")


@query(f"SELECT p.ino, p.snap_id, max(p.off) + 1 AS next_offset FROM placed p JOIN placed n ON n.place = {BUDGET + 1} AND n.op = 'extent' AND n.ino = p.ino AND n.snap_id = p.snap_id WHERE p.place <= {BUDGET} GROUP BY ALL", f"{_BASE},\n{_WORK}")
def reclaim_progress(spark, d):
    return M.reclaim_progress(_reclaim(spark, d))


@query("SELECT o_orderkey, greatest(0, greatest(0, 960 - (o_orderkey % 1100)) - (o_custkey % 50 + 3)) AS headroom FROM orders")
def reclaim_headroom(spark, d):
    room = M.reclaim_headroom(F.col("o_orderkey") % 1100 + 5, F.lit(5), F.col("o_custkey") % 50)
    return A.read(spark, d, "orders").select("o_orderkey", room.alias("headroom"))


@query("SELECT (SELECT max(data_block) + 1 FROM e) AS total_blocks, (SELECT count(*) FROM e WHERE kind = 2) AS free_blocks")
def statfs(spark, d):
    blocks = A.extents(spark, d).select("kind", F.col("data_block").alias("block_nr"))
    return M.statfs(blocks, blocks.filter("kind = 2"))


@query("SELECT (row_number() OVER (ORDER BY data_block) - 1) // 510 AS chunk, (row_number() OVER (ORDER BY data_block) - 1) % 510 AS place, data_block AS block_nr FROM e WHERE kind = 2")
def free_list_chunks(spark, d):
    return M.free_list_chunks(A.extents(spark, d).filter("kind = 2").select(F.col("data_block").alias("block_nr")))


# -- writes


@query(f"SELECT ino, off, snap_id, kind, seq FROM (SELECT ino, off, snap_id, kind, seq FROM m UNION ALL SELECT ino, off, {HEAD}, 0, seq + 1000000000 FROM m WHERE kind = 1 AND snap_id = {HEAD}) QUALIFY row_number() OVER (PARTITION BY ino, off, snap_id ORDER BY seq DESC) = 1")
def upsert(spark, d):
    e = A.extents(spark, d)
    # Everything that the head had deleted is put again.
    puts = V.newest(e, KEY).filter(f"kind = 1 AND snap_id = {HEAD}").withColumn("kind", F.lit(0)).withColumn("seq", F.col("seq") + 1_000_000_000)
    return U.upsert(e, U.checked_batch(puts, KEY), KEY).select("ino", "off", "snap_id", "kind", "seq")


@query(f"SELECT t.ino, t.off, {HEAD} AS snap_id, CASE WHEN vis.snap_id = {HEAD} THEN 1 WHEN vis.snap_id IS NOT NULL THEN 2 END AS kind, vis.snap_id IS NOT NULL AS deleted FROM (SELECT DISTINCT ino, off FROM e) t LEFT JOIN vis USING (ino, off)")
def delete_resolve(spark, d):
    e = A.extents(spark, d)
    return U.delete_resolve(e, e.select(*KEY), KEY, _chain(spark))


_GONE = f"""hit AS (SELECT d.parent_ino, d.name, d.target_ino, i.nlink FROM dirent d JOIN ino i ON i.ino = d.target_ino WHERE i.mode = 33188),
per AS (SELECT target_ino, max(nlink) - count(*) AS rest FROM hit GROUP BY target_ino)"""


@query(
    f"""SELECT 'dirent' AS "table", target_ino AS ino, parent_ino, name, {HEAD} AS snap_id, 2 AS kind, NULL::BIGINT AS nlink FROM hit
UNION ALL SELECT 'inode', target_ino, NULL, NULL, {HEAD}, CASE WHEN rest <= 0 THEN 2 ELSE 0 END, CASE WHEN rest > 0 THEN rest END FROM per
UNION ALL SELECT 'deleted_inode', target_ino, NULL, NULL, {HEAD}, 0, NULL FROM per WHERE rest <= 0""",
    f"{_TREE},\n{_GONE}",
)
def unlink(spark, d):
    return N.unlink(_names(spark, d), A.inodes(spark, d).drop("parent_ino"), None, HEAD)


_MOVES = """mv AS (
  SELECT parent_ino, name, parent_ino AS new_parent, 'moved-' || name AS new_name FROM dirent WHERE parent_ino = 11
  UNION ALL SELECT 11, 'no such name', 11, 'x' UNION ALL SELECT parent_ino, name, parent_ino, name FROM dirent WHERE parent_ino = 1),
ruled AS (
  SELECT mv.*, s.target_ino, CASE WHEN s.target_ino IS NULL THEN 'not found' WHEN t.target_ino IS NOT NULL THEN 'already exists' ELSE 'ok' END AS verdict
  FROM mv LEFT JOIN dirent s ON s.parent_ino = mv.parent_ino AND s.name = mv.name LEFT JOIN dirent t ON t.parent_ino = new_parent AND t.name = new_name)"""


@query("SELECT verdict, parent_ino, name, CASE WHEN verdict = 'ok' THEN 2 END AS kind, target_ino FROM ruled UNION ALL SELECT verdict, new_parent, new_name, 0, target_ino FROM ruled WHERE verdict = 'ok'", f"{_TREE},\n{_MOVES}")
def rename(spark, d):
    names = _names(spark, d).filter("parent_ino IN (1, 11)")
    own = names.filter("parent_ino = 11")
    moves = own.select("parent_ino", "name", F.col("parent_ino").alias("new_parent"), F.concat(F.lit("moved-"), F.col("name")).alias("new_name"))
    moves = moves.union(spark.sql("SELECT 11L, 'no such name', 11L, 'x'"))
    moves = moves.union(names.filter("parent_ino = 1").select("parent_ino", "name", "parent_ino", "name"))
    return N.rename(names, moves, HEAD)


@query(f"SELECT ino, off, CASE WHEN off >= 10000 THEN 0 ELSE 10000 - off END AS new_len, {HEAD} AS snap_id, CASE WHEN off >= 10000 THEN CASE WHEN snap_id = {HEAD} THEN 1 ELSE 2 END ELSE 0 END AS kind, off >= 10000 AND snap_id = {HEAD} AS frees FROM vis WHERE off + len > 10000")
def truncate(spark, d):
    seen = V.visible(A.extents(spark, d), KEY, _chain(spark))
    return X.truncate(seen, seen.select("ino").distinct().withColumn("size", F.lit(10_000)), HEAD)


# -- the log


@query("SELECT event_id % 1024 AS slot, max(event_id) AS seq, max_by(event_type = 'purchase', event_id) AS is_commit FROM events GROUP BY 1")
def ring_slots(spark, d):
    return J.ring_slots(A.frames(spark, d).select("seq", "is_commit"))


@query("SELECT seq, is_commit FROM pre", _LOG.replace("{src}", "pre"))
def journal_valid_prefix(spark, d):
    return J.valid_prefix(A.frames(spark, d), 0).select("seq", "is_commit")


@query("SELECT seq, is_commit, group_id FROM closed", _LOG.replace("{src}", "f"))
def journal_groups(spark, d):
    return J.groups(A.frames(spark, d)).select("seq", "is_commit", "group_id")


@query("SELECT coalesce(max(seq) + 1, 0) AS next_seq FROM pre WHERE is_commit", _LOG.replace("{src}", "pre"))
def journal_next_seq(spark, d):
    return J.next_seq(J.valid_prefix(A.frames(spark, d), 0), 0)


@query(
    f"SELECT ino, off, snap_id, kind, seq FROM e WHERE snap_id = {ROOT} OR seq IN (SELECT seq FROM closed WHERE NOT is_commit) QUALIFY row_number() OVER (PARTITION BY ino, off, snap_id ORDER BY seq DESC) = 1",
    _LOG.replace("{src}", "pre"),
)
def journal_replay(spark, d):
    base = A.extents(spark, d).filter(F.col("snap_id") == ROOT)
    return J.replay(base, A.frames(spark, d), 0, KEY).select("ino", "off", "snap_id", "kind", "seq")


# -- the namespace


@query("SELECT i.ino, NOT EXISTS (SELECT 1 FROM dirent WHERE dirent.parent_ino = i.ino) AS is_empty FROM ino i WHERE mode = 16877", _TREE)
def dir_is_empty(spark, d):
    return N.dir_is_empty(_names(spark, d), A.inodes(spark, d))


@query("SELECT i.ino, nlink, count(target_ino) AS n_links FROM ino i LEFT JOIN dirent ON target_ino = i.ino WHERE mode = 33188 GROUP BY i.ino, nlink HAVING nlink <> count(target_ino)", _TREE)
def nlink_audit(spark, d):
    return N.nlink_audit(_names(spark, d), A.inodes(spark, d))


@query("SELECT d.parent_ino AS ino, count(*) AS n_entries, CAST(sum(CAST(ceil(size / 4096.0) AS BIGINT)) AS BIGINT) AS n_blocks FROM dirent d JOIN ino i ON i.ino = target_ino GROUP BY d.parent_ino", _TREE)
def block_usage(spark, d):
    return N.block_usage(_names(spark, d), A.inodes(spark, d))


_NAME = "CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '.' WHEN 2 THEN 'a/b' || doc_id WHEN 3 THEN 'name-' || doc_id WHEN 4 THEN 'ééééééééé' || doc_id ELSE '..' END"


@query(f"SELECT doc_id, CASE WHEN n = '' THEN 'empty' WHEN n IN ('.', '..') THEN 'reserved' WHEN contains(n, '/') THEN 'character' WHEN strlen(n) > 19 THEN 'too long' END AS problem FROM (SELECT doc_id, {_NAME} AS n FROM documents)")
def validate_name(spark, d):
    names = A.read(spark, d, "documents").select("doc_id", F.expr(_NAME).alias("n"))
    return names.select("doc_id", K.name_problem(F.col("n")).alias("problem"))


# -- bytes


@query("SELECT doc_id AS ino, b * 4096 AS off, greatest(0, s - b * 4096) AS in_block, least((b + 1) * 4096, s + n) - greatest(b * 4096, s) AS n FROM (SELECT doc_id, doc_id % 5 * 1000 AS s, strlen(text) AS n FROM documents), unnest(range(s // 4096, (s + n - 1) // 4096 + 1)) AS t(b) WHERE n > 0")
def write_chunks(spark, d):
    cut = X.write_chunks(A.contents(spark, d))
    return cut.select("ino", "off", "in_block", F.octet_length("piece").cast("long").alias("n"))


@query("SELECT ino, max(off + len) AS size FROM vis GROUP BY ino")
def file_size(spark, d):
    return X.file_size(V.visible(A.extents(spark, d), KEY, _chain(spark)))


_READ = """sz AS (SELECT ino, max(off + len) AS size FROM vis GROUP BY ino),
r AS (SELECT ino, 1000::BIGINT AS start, least(1000 + 30000, size) AS stop FROM sz WHERE size > 1000),
p AS (SELECT r.ino, start, stop, b * 4096 AS off FROM r, unnest(range(start // 4096, (stop - 1) // 4096 + 1)) AS t(b)),
q AS (SELECT p.*, data_block, greatest(p.off, start) AS a, least(p.off + 4096, stop) AS z, p.off + coalesce(len, 0) AS e FROM p LEFT JOIN vis ON vis.ino = p.ino AND vis.off = p.off)"""


@query("SELECT ino, start, a AS at, greatest(0, least(z, e) - a) AS n, data_block, a - off AS skip FROM q WHERE least(z, e) > a UNION ALL SELECT ino, start, greatest(a, least(z, e)), z - greatest(a, least(z, e)), NULL, 0 FROM q WHERE z > greatest(a, least(z, e))", f"{_BASE},\n{_READ}")
def read_at(spark, d):
    seen = V.visible(A.extents(spark, d), KEY, _chain(spark))
    sizes = X.file_size(seen)
    reads = sizes.select("ino", F.lit(1000).cast("long").alias("start"), F.lit(30_000).cast("long").alias("count"))
    return X.read_segments(sizes, seen, reads)


# -- the snapshot tree of the data, deeper than a hundred levels

_DEEP = """WITH RECURSIVE snaps AS (
  SELECT 4294967295 - c_custkey AS snap_id, CASE WHEN c_custkey = 0 THEN 0 WHEN c_custkey % 50 = 0 THEN 4294967295 - c_custkey // 2 ELSE 4294967295 - (c_custkey - 1) END AS parent_id, CAST(c_custkey % 2 AS INT) AS flags FROM customer),
subvols AS (
  SELECT s_suppkey + 1 AS subvol_id, 4294967295 - s_suppkey * 13 % 140 AS snap_id, CAST(s_suppkey % 3 % 2 AS INT) AS flags, CASE WHEN s_suppkey = 0 THEN 0 ELSE s_suppkey // 4 + 1 END AS parent_subvol FROM supplier),
up(start, snap_id, depth) AS (
  SELECT snap_id, snap_id, 0 FROM snaps UNION ALL
  SELECT up.start, s.parent_id, up.depth + 1 FROM up JOIN snaps s ON s.snap_id = up.snap_id WHERE s.parent_id <> 0)"""


@query("SELECT start, snap_id, depth FROM up", _DEEP)
def ancestor_chain_deep(spark, d):
    return C.closure(A.deep_snapshots(spark, d))


_PAIRS = "SELECT s.snap_id AS ancestor, v.snap_id AS of FROM snaps s, (SELECT DISTINCT snap_id FROM subvols) v".replace("AS of", 'AS "of"')


@query(f"""SELECT ancestor, "of", EXISTS (SELECT 1 FROM up WHERE start = p."of" AND up.snap_id = ancestor) AS is_ancestor FROM ({_PAIRS}) p""", _DEEP)
def is_ancestor_deep(spark, d):
    s, v = A.deep_snapshots(spark, d), A.deep_subvols(spark, d)
    heads = v.select(F.col("snap_id").alias("of")).distinct()
    return C.is_ancestor(s, s.select(F.col("snap_id").alias("ancestor")).crossJoin(F.broadcast(heads)))


@query("SELECT subvol_id, snap_id, has_child, has_dependent FROM b", f"{_DEEP},\n{_BUSY}")
def snapshot_busy_deep(spark, d):
    return S.busy(A.deep_snapshots(spark, d), A.deep_subvols(spark, d))


@query(
    f"""SELECT subvol_id, CASE WHEN subvol_id = 1 THEN 'invalid: root' WHEN flags % 2 = 0 THEN 'invalid: writable' WHEN subvol_id = 2 THEN 'busy: active' WHEN snap_id = {ROOT} THEN 'invalid: root snapshot'
  WHEN has_child THEN 'busy: child' WHEN has_dependent THEN 'busy: dependent' ELSE 'ok' END AS verdict FROM b""",
    f"{_DEEP},\n{_BUSY}",
)
def snapshot_delete_check_deep(spark, d):
    v = A.deep_subvols(spark, d)
    return S.delete_check(A.deep_snapshots(spark, d), v, 2, v.select("subvol_id"))


@query(f"SELECT snap_id, parent_id, flags FROM snaps WHERE snap_id <> {ROOT} AND snap_id NOT IN (SELECT up.snap_id FROM up JOIN subvols ON subvols.snap_id = start)", _DEEP)
def sweep_unreferenced_deep(spark, d):
    return S.unreferenced(A.deep_snapshots(spark, d), A.deep_subvols(spark, d))


@query(f"SELECT snap_id, parent_id, flags FROM snaps WHERE snap_id = {SIDE}")
def get_snapshot(spark, d):
    return S.get_snapshot(A.snapshots(spark), SIDE)


@query("SELECT subvol_id, snap_id, flags, parent_subvol FROM subvols WHERE subvol_id = 3")
def get_subvol(spark, d):
    return S.get_subvol(A.subvols(spark), 3)


@query("SELECT subvol_id, snap_id, flags, parent_subvol FROM subvols ORDER BY subvol_id", _DEEP)
def list_subvols(spark, d):
    return S.list_subvols(A.deep_subvols(spark, d))


@query(f"SELECT ino, off, data_block, len FROM (SELECT * FROM m WHERE snap_id IN (SELECT snap_id FROM up WHERE start = {SIDE}) QUALIFY row_number() OVER (PARTITION BY ino, off ORDER BY snap_id) = 1) WHERE kind = 0")
def switch_subvol(spark, d):
    head = S.switch_subvol(A.subvols(spark), 2)
    return V.visible(A.extents(spark, d), KEY, _chain(spark, head)).select("ino", "off", "data_block", "len")


@query(f"SELECT {ROOT} AS snap_id, 0::BIGINT AS parent_id, 0 AS flags, 1::BIGINT AS subvol_id")
def seed(spark, d):
    snaps, vols = S.seed(spark)
    return snaps.join(vols.select("subvol_id", "snap_id"), "snap_id").select("snap_id", "parent_id", "flags", "subvol_id")


# -- counts and blocks


@query(f"SELECT count(*) FILTER (WHERE kind = 2) AS whiteouts, count(*) AS keys FROM m WHERE snap_id IN ({SIDE}, {MIDDLE})")
def compact_counts(spark, d):
    return M.dropped(A.extents(spark, d), KEY, [SIDE, MIDDLE])


@query("SELECT ino, snap_id, next_offset FROM work ORDER BY ino, snap_id", f"{_BASE},\n{_WORK}")
def list_deleted_inodes(spark, d):
    return A.work_items(spark, d).orderBy("ino", "snap_id").select("ino", "snap_id", "next_offset")


_FREE = """fl AS (SELECT row_number() OVER (ORDER BY data_block) - 1 AS place, data_block AS block_nr FROM e WHERE kind = 2)"""


@query("SELECT r.c_custkey, coalesce(block_nr, (SELECT max(data_block) + 1 FROM e) + nth - (SELECT count(*) FROM fl) - 1) AS block_nr FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS nth FROM customer) r LEFT JOIN (SELECT row_number() OVER (ORDER BY place DESC) AS nth, block_nr FROM fl) s USING (nth)", f"{_BASE},\n{_FREE}")
def alloc_blocks(spark, d):
    e = A.extents(spark, d)
    free = U.numbered(e.filter("kind = 2").select(F.col("data_block").alias("block_nr")), 0, ["block_nr"]).withColumnRenamed("seq", "place")
    return M.alloc_blocks(free, A.read(spark, d, "customer").select("c_custkey"), (e.agg(F.max("data_block")).first()[0] or 64) + 1, ["c_custkey"])


@query("SELECT block_nr FROM fl UNION SELECT block_nr + 1 FROM fl WHERE place % 510 = 0", f"{_BASE},\n{_FREE}")
def freed_blocks(spark, d):
    free = A.extents(spark, d).filter("kind = 2").select(F.col("data_block").alias("block_nr"))
    heads = M.free_list_chunks(free).filter("place = 0").select((F.col("block_nr") + 1).alias("block_nr"))
    return M.freed_blocks(free, heads)


# -- handlers


@query("SELECT parent_ino, name, target_ino FROM (SELECT ino AS parent_ino, '.' AS name, ino AS target_ino FROM ino WHERE mode = 16877 UNION ALL SELECT ino, '..', CASE WHEN parent_ino = 0 THEN ino ELSE parent_ino END FROM ino WHERE mode = 16877)", _TREE)
def lookup_dots(spark, d):
    return N.lookup_dots(A.inodes(spark, d))


@query("SELECT ino, CASE mode WHEN 16877 THEN 2 ELSE 1 END AS file_kind, CASE mode WHEN 16877 THEN 493 ELSE 420 END AS perm, nlink, size, CAST(ceil(size / 4096.0) AS BIGINT) AS blocks FROM ino", _TREE)
def getattr(spark, d):
    return N.attributes(A.inodes(spark, d))


_MAKE = """rq AS (
  SELECT o_orderkey AS req, o_custkey + 1000 AS parent_ino, CASE o_orderkey % 7 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'a/b' WHEN 2 THEN 'twin' ELSE 'new' || o_orderkey END AS name,
    CAST(o_orderkey % 3 + 1 AS INT) AS file_kind, CASE WHEN o_orderkey % 3 = 2 THEN 'target ' || o_orderkey END AS target FROM orders),
rl AS (
  SELECT *, CASE WHEN name = 'a/b' THEN 'invalid: character' WHEN EXISTS (SELECT 1 FROM dirent x WHERE x.parent_ino = rq.parent_ino AND x.name = rq.name) OR row_number() OVER (PARTITION BY parent_ino, name ORDER BY req) > 1 THEN 'already exists' ELSE 'ok' END AS verdict FROM rq),
mk AS (SELECT req, row_number() OVER (ORDER BY req) - 1 + 20000000 AS ino FROM rl WHERE verdict = 'ok')"""


@query(
    """SELECT req, verdict, ino, parent_ino, name, file_kind, CASE WHEN ino IS NOT NULL THEN CASE file_kind WHEN 1 THEN 33188 WHEN 2 THEN 16804 ELSE 41471 END END AS mode, CASE WHEN ino IS NOT NULL THEN 7 END AS uid, CASE WHEN ino IS NOT NULL THEN 8 END AS gid,
  CASE WHEN ino IS NOT NULL THEN CASE file_kind WHEN 2 THEN 2 ELSE 1 END END AS nlink, CASE WHEN ino IS NOT NULL THEN CASE file_kind WHEN 3 THEN strlen(target) ELSE 0 END END AS size,
  CASE WHEN ino IS NOT NULL THEN 1700000000 END AS atime, CASE WHEN ino IS NOT NULL THEN 1700000000 END AS mtime, CASE WHEN ino IS NOT NULL THEN 1700000000 END AS ctime FROM rl LEFT JOIN mk USING (req)""",
    f"{_TREE},\n{_MAKE}",
)
def make(spark, d):
    key = F.col("o_orderkey")
    name = F.when(key % 7 == 0, key.cast("string")).when(key % 7 == 1, "a/b").when(key % 7 == 2, "twin").otherwise(F.concat(F.lit("new"), key.cast("string")))
    target = F.when(key % 3 == 2, F.concat(F.lit("target "), key.cast("string")))
    asked = A.read(spark, d, "orders").select(key.alias("req"), (F.col("o_custkey") + 1000).alias("parent_ino"), name.alias("name"), (key % 3 + 1).cast("int").alias("file_kind"), F.lit(0o644).alias("mode"), F.lit(7).alias("uid"), F.lit(8).alias("gid"), target.alias("target"))
    return N.make(_names(spark, d), asked, FIRST_INO, NOW)


_LINK = """rq AS (
  SELECT o_orderkey AS req, CASE o_orderkey % 5 WHEN 0 THEN o_custkey + 1000 WHEN 1 THEN 5 ELSE (o_orderkey // 4) * 4 + 10000000 END AS ino, o_custkey + 1000 AS parent_ino, CASE o_orderkey % 7 WHEN 0 THEN '..' WHEN 1 THEN 'twin' ELSE 'link' || o_orderkey END AS name FROM orders),
rl AS (
  SELECT rq.*, i.nlink AS had, CASE WHEN name = '..' THEN 'invalid: reserved' WHEN mode IS NULL THEN 'not found' WHEN mode = 16877 THEN 'not permitted' WHEN row_number() OVER (PARTITION BY rq.parent_ino, name ORDER BY req) > 1 THEN 'already exists' ELSE 'ok' END AS verdict
  FROM rq LEFT JOIN ino i ON i.ino = rq.ino)"""


@query("SELECT req, verdict, ino, parent_ino, name, CASE WHEN verdict = 'ok' THEN 1 END AS file_kind, CASE WHEN verdict = 'ok' THEN had + count(*) FILTER (WHERE verdict = 'ok') OVER (PARTITION BY ino) END AS nlink, CASE WHEN verdict = 'ok' THEN 1700000000 END AS ctime FROM rl", f"{_TREE},\n{_LINK}")
def link(spark, d):
    key = F.col("o_orderkey")
    target = F.when(key % 5 == 0, F.col("o_custkey") + 1000).when(key % 5 == 1, 5).otherwise(F.floor(key / 4) * 4 + 10_000_000).cast("long")
    name = F.when(key % 7 == 0, "..").when(key % 7 == 1, "twin").otherwise(F.concat(F.lit("link"), key.cast("string")))
    asked = A.read(spark, d, "orders").select(key.alias("req"), target.alias("ino"), (F.col("o_custkey") + 1000).alias("parent_ino"), name.alias("name"))
    return N.link(_names(spark, d), A.inodes(spark, d), asked, NOW)


@query(
    """SELECT o_orderkey + CASE WHEN o_orderkey % 4 = 3 THEN 90000000 ELSE 10000000 END AS ino, CASE WHEN o_orderkey % 4 = 3 THEN 'not found' ELSE 'ok' END AS verdict,
  CASE o_orderkey % 4 WHEN 0 THEN 33152 WHEN 3 THEN NULL ELSE 33188 END AS mode, CASE o_orderkey % 4 WHEN 1 THEN 9 WHEN 3 THEN NULL ELSE 0 END AS uid, CASE WHEN o_orderkey % 4 <> 3 THEN 0 END AS gid,
  CASE o_orderkey % 4 WHEN 2 THEN 5000000 WHEN 3 THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS size, CASE WHEN o_orderkey % 4 <> 3 THEN 5 END AS atime, CASE o_orderkey % 4 WHEN 1 THEN 77 WHEN 3 THEN NULL ELSE 6 END AS mtime,
  CASE WHEN o_orderkey % 4 <> 3 THEN 1700000000 END AS ctime, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 4 = 2 AND CAST(round(o_totalprice * 100) AS BIGINT) > 5000000 END AS shrinks FROM orders""",
    "",
)
def setattr(spark, d):
    key = F.col("o_orderkey")
    when = lambda r, v, t: F.when(key % 4 == r, v).cast(t)
    asked = A.read(spark, d, "orders").select((key + F.when(key % 4 == 3, 90_000_000).otherwise(10_000_000)).alias("ino"), when(0, 0o600, "int").alias("mode"), when(1, 9, "int").alias("uid"), F.lit(None).cast("int").alias("gid"), when(2, 5_000_000, "long").alias("size"), F.lit(None).cast("long").alias("atime"), when(1, 77, "long").alias("mtime"))
    own = A.inodes(spark, d).withColumns({"uid": F.lit(0), "gid": F.lit(0), "atime": F.lit(5).cast("long"), "mtime": F.lit(6).cast("long")})
    return N.setattr(own, asked, NOW)


_RMDIR = """rq AS (SELECT parent_ino, name FROM dirent UNION SELECT parent_ino, 'no ' || name FROM dirent),
rl AS (
  SELECT rq.*, t.target_ino AS ino, CASE WHEN t.target_ino IS NULL THEN 'not found' WHEN t.file_kind <> 2 THEN 'not a directory' WHEN EXISTS (SELECT 1 FROM dirent c WHERE c.parent_ino = t.target_ino) THEN 'not empty' ELSE 'ok' END AS verdict
  FROM rq LEFT JOIN dirent t ON t.parent_ino = rq.parent_ino AND t.name = rq.name)"""


@query("SELECT verdict, parent_ino, name, ino, CASE WHEN verdict = 'ok' THEN 2 END AS dirent_kind, CASE WHEN verdict = 'ok' THEN 2 END AS inode_kind FROM rl", f"{_TREE},\n{_RMDIR}")
def rmdir(spark, d):
    names = _names(spark, d)
    asked = names.select("parent_ino", "name").union(names.select("parent_ino", F.concat(F.lit("no "), F.col("name"))))
    return N.rmdir(names, A.inodes(spark, d), asked, HEAD)


@query("SELECT rq.parent_ino, rq.name, CASE WHEN target_ino IS NULL THEN 'not found' WHEN file_kind = 2 THEN 'is a directory' ELSE 'ok' END AS verdict FROM rq LEFT JOIN dirent t ON t.parent_ino = rq.parent_ino AND t.name = rq.name", f"{_TREE},\n{_RMDIR}")
def unlink_check(spark, d):
    names = _names(spark, d)
    asked = names.select("parent_ino", "name").union(names.select("parent_ino", F.concat(F.lit("no "), F.col("name"))))
    return N.unlink_check(names, A.inodes(spark, d), asked)


@query(
    "SELECT verdict, parent_ino, name, CASE WHEN verdict = 'ok' THEN 2 END AS kind, target_ino FROM rv UNION ALL SELECT verdict, new_parent, new_name, 0, target_ino FROM rv WHERE verdict = 'ok'",
    f"""{_TREE},
mv AS (SELECT parent_ino, name, 1::BIGINT AS new_parent, 'm' || target_ino % 1000 AS new_name, target_ino FROM dirent),
rv AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY new_name ORDER BY parent_ino, name) > 1 THEN 'already exists' ELSE 'ok' END AS verdict FROM mv)""",
)
def rename_to_one(spark, d):
    names = _names(spark, d)
    target = F.concat(F.lit("m"), (F.col("target_ino") % 1000).cast("string"))
    return N.rename(names, names.select("parent_ino", "name", F.lit(1).cast("long").alias("new_parent"), target.alias("new_name")), HEAD)


@query("SELECT ino, CASE WHEN mode IN (16877, 33188) THEN 'invalid' END AS verdict, 0::BIGINT AS start, NULL::BIGINT AS count FROM ino", _TREE)
def readlink(spark, d):
    own = A.inodes(spark, d)
    return N.readlink(own, own)


@query("SELECT ino, greatest(s.size, w.stop) AS size, 1700000000::BIGINT AS mtime, 1700000000::BIGINT AS ctime FROM (SELECT ino, max(off + len) AS size FROM vis GROUP BY ino) s JOIN (SELECT doc_id AS ino, doc_id % 5 * 1000 + coalesce(strlen(text), 0) AS stop FROM documents) w USING (ino)")
def written_sizes(spark, d):
    sizes = X.file_size(V.visible(A.extents(spark, d), KEY, _chain(spark)))
    writes = A.contents(spark, d).select("ino", "start", F.coalesce(F.octet_length("data"), F.lit(0)).alias("n"))
    return N.written(sizes, writes, NOW)


# -- the log's records and groups


@query("SELECT event_id AS seq, format('1C{:016X}{:016X}{:08X}', ino, off, snap_id) || '000000' || format('{:016X}', data_block)  AS hex, format('{:016X}{:016X}{:08X}', ino, off, snap_id) AS key, '000000' || format('{:016X}', data_block) AS value FROM (SELECT seq AS event_id, * FROM e)".replace("1C", "14"))
def log_records(spark, d):
    key = K.sortable(F.concat(K.be(F.col("ino"), 8), K.be(F.col("off"), 8)), F.col("snap_id"))
    rows = A.extents(spark, d).select("seq", K.encoded_record(key, K.be(F.col("data_block"), 11)).alias("r"))
    rows = rows.withColumn("back", K.decoded_record(F.col("r")))
    return rows.select("seq", F.hex("r").alias("hex"), F.hex("back.key").alias("key"), F.hex("back.value").alias("value"))


@query("SELECT 5000000000 + row_number() OVER (ORDER BY ino, off, snap_id) - 1 AS seq, false AS is_commit, true AS valid, ino, off, snap_id, kind FROM m UNION ALL SELECT 5000000000 + (SELECT count(*) FROM m), true, true, NULL, NULL, NULL, NULL")
def journal_commit(spark, d):
    ops = V.newest(A.extents(spark, d), KEY).select("ino", "off", "snap_id", "kind")
    return J.commit(ops, 5_000_000_000, 4_999_999_900, ["ino", "off", "snap_id"])[0]


@query("SELECT event_id, epoch_us(ts) // 1000000 AS seconds FROM events", "")
def epoch_seconds(spark, d):
    return A.read(spark, d, "events").select("event_id", K.epoch_seconds(F.col("ts")).alias("seconds"))


@query("SELECT count(*) - count(DISTINCT (ino, off, snap_id, seq)) AS repeated, count(*) FILTER (WHERE kind NOT IN (0, 1, 2)) AS odd_kinds, count(*) FILTER (WHERE off % 4096 <> 0 OR len NOT BETWEEN 1 AND 4096) AS odd_extents FROM e")
def verify(spark, d):
    e = A.extents(spark, d)
    odd = F.count_if((F.col("off") % K.BLOCK != 0) | ~F.col("len").between(1, K.BLOCK))
    counts = e.groupBy(*KEY, "snap_id", "seq").agg(F.count("*").alias("n"), F.count_if(~F.col("kind").isin(0, 1, 2)).alias("k"), odd.alias("x"))
    return counts.agg(F.sum(F.col("n") - 1).alias("repeated"), F.sum("k").alias("odd_kinds"), F.sum("x").alias("odd_extents"))
