import pytest
from pyspark.sql import functions as F

from palimpsest.functions import keys as K
from palimpsest.operators import errors as E
from palimpsest.operators import files as X
from palimpsest.operators import journal as J
from palimpsest.operators import maintain as M
from palimpsest.operators import mutate as U
from palimpsest.operators import namespace as N
from palimpsest.operators import snapshot as S
from palimpsest.sources import adapters as A
from palimpsest.sources.session import Session
from palimpsest.sources.store import Store
from palimpsest.streaming import tail

ROOT = K.ROOT_SNAP
EXTENT = "ino long, off long, snap_id long, kind int, seq long, data_block long, len long"


# -- snapshots


def test_nested_snapshots_and_sweep(spark):
    snaps = spark.createDataFrame([(ROOT, 0, 0)], "snap_id long, parent_id long, flags int")
    vols = spark.createDataFrame([(1, ROOT, 0, 0)], "subvol_id long, snap_id long, flags int, parent_subvol long")
    snaps, vols = S.create(snaps, vols, 1)
    assert {tuple(r) for r in snaps.collect()} == {(ROOT, 0, 0), (ROOT - 1, ROOT, 0), (ROOT - 2, ROOT, 1)}
    assert {(r.subvol_id, r.snap_id, r.flags) for r in vols.collect()} == {(1, ROOT - 1, 0), (2, ROOT - 2, 1)}
    snaps, vols = S.create(snaps, vols, 2)
    check = lambda ids, active=1: {r.subvol_id: r.verdict for r in S.delete_check(snaps, vols, active, spark.createDataFrame([(i,) for i in ids], "subvol_id long")).collect()}
    assert check([1, 2, 3, 9]) == {1: "invalid: root", 2: "busy: dependent", 3: "ok", 9: "not found"}
    assert check([3], active=3) == {3: "busy: active"}
    snaps, vols, dead = S.delete(snaps, vols, 1, 3)
    assert dead == [ROOT - 4] and check([2]) == {2: "ok"}
    snaps, vols, dead = S.delete(snaps, vols, 1, 2)
    assert sorted(dead) == [ROOT - 3, ROOT - 2]
    assert sorted(r.snap_id for r in snaps.collect()) == [ROOT - 1, ROOT]
    with pytest.raises(E.NotFound):
        S.create(snaps, vols, 77)


def test_ids_run_out(spark):
    snaps = spark.createDataFrame([(2, 0, 0)], "snap_id long, parent_id long, flags int")
    vols = spark.createDataFrame([(1, 2, 0, 0)], "subvol_id long, snap_id long, flags int, parent_subvol long")
    with pytest.raises(E.Exhausted):
        S.create(snaps, vols, 1)


# -- bounded work


def test_reclaim_in_slices(spark):
    extents = spark.createDataFrame([(5, 4096 * i, ROOT, 0, i, 65 + i, 8) for i in range(5)], EXTENT)
    snaps = spark.createDataFrame([(ROOT, 0, 0)], "snap_id long, parent_id long, flags int")
    cursor, log, seen = 0, extents, []
    for budget in (2, 2, 1, 1):
        work = spark.createDataFrame([(5, ROOT, cursor)], "ino long, snap_id long, next_offset long")
        ops = M.reclaim(log, work, snaps, budget)
        issued = ops.filter("issued").orderBy("place").collect()
        seen.append([r.op for r in issued])
        gone = [r.off for r in issued if r.op == "extent"]
        log = log.withColumn("kind", F.when(F.col("off").isin(gone), 1).otherwise(F.col("kind"))) if gone else log
        left = M.reclaim_progress(ops).collect()
        cursor = left[0].next_offset if left else cursor
        seen.append(cursor)
    assert seen == [["extent"] * 2, 4097, ["extent"] * 2, 12289, ["extent"], 12289, ["drop"], 12289]


def test_shared_extents_are_not_freed(spark):
    extents = spark.createDataFrame([(5, 0, ROOT, 0, 1, 65, 8), (5, 4096, 100, 0, 2, 66, 8)], EXTENT)
    snaps = spark.createDataFrame([(ROOT, 0, 0), (100, ROOT, 0)], "snap_id long, parent_id long, flags int")
    work = spark.createDataFrame([(5, 100, 0), (6, 77, 0)], "ino long, snap_id long, next_offset long")
    got = [(r.op, r.off, r.frees) for r in M.reclaim(extents, work, snaps, 9).orderBy("place").collect()]
    assert got == [("extent", 0, False), ("extent", 4096, True), ("drop", None, False), ("orphan", None, False)]


def test_headroom(spark):
    room = lambda n, c, p: spark.range(1).select(M.reclaim_headroom(F.lit(n), F.lit(c), F.lit(p)).alias("r")).first().r
    assert room(955, 0, 1) == 1 and room(2000, 0, 1) == 0 and room(0, 0, 0) == 957


def test_numbered_is_dense_and_ordered(spark):
    rows = U.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(7), 5, ["x"]).collect()
    assert {r.x: r.seq for r in rows} == {i: i + 5 for i in range(1000)}


@pytest.fixture
def many_parts(spark):
    """Shuffles keep all their partitions, as those of large tables do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, was)


def test_blocks_are_allocated_in_order_over_many_partitions(spark, many_parts):
    n, m = 40_000, 30_000
    free = spark.range(m).select(F.col("id").alias("place"), (F.col("id") * 3).alias("block_nr")).repartition(7)
    rows = M.alloc_blocks(free, spark.range(n).select((F.col("id") * 7 % n).alias("k"), F.lit("x").alias("more")).repartition(5), 100_000, ["k"]).collect()
    assert {r.k: r.block_nr for r in rows} == {i: (m - 1 - i) * 3 if i < m else 100_000 + i - m for i in range(n)} and len(rows) == n


def test_frames_of_a_commit_are_in_order_over_many_partitions(spark, many_parts):
    n = 40_000
    ino, off = F.floor(F.col("id") / 8), F.when(F.col("id") % 8 < 7, F.col("id") % 8)  # a null goes last, as in SQL
    ops = spark.range(n).select(F.col("id").alias("v"), ino.alias("ino"), off.alias("off"), F.lit(0).alias("kind")).repartition(7)
    frames, next_seq, _ = J.commit(ops, 500, 500, ["ino", "off"])
    rows = frames.collect()
    assert sorted((r.seq, r.is_commit, r.v) for r in rows)[:-1] == [(500 + i, False, i) for i in range(n)]
    assert next_seq == 501 + n and [(r.seq, r.v) for r in rows if r.is_commit] == [(500 + n, None)]


def test_inodes_are_made_in_order_over_many_partitions(spark, many_parts):
    n = 30_000
    names = spark.createDataFrame([(1, "n0")], "parent_ino long, name string")
    name = F.when(F.col("id") % 3 == 1, "twin").otherwise(F.concat(F.lit("n"), F.col("id")))
    asked = spark.range(n).select(F.col("id").alias("req"), F.lit(1).cast("long").alias("parent_ino"), name.alias("name"), F.lit(1).alias("file_kind"), F.lit(0o644).alias("mode"), F.lit(7).alias("uid"), F.lit(8).alias("gid"), F.lit("").alias("target"))
    rows = N.make(names, asked.repartition(7), 900, 5).collect()
    ok = [i for i in range(1, n) if i % 3 != 1 or i == 1]
    assert sorted((r.req, r.ino) for r in rows if r.verdict == "ok") == [(i, 900 + at) for at, i in enumerate(ok)]
    assert len(rows) == n and {r.verdict for r in rows} == {"ok", "already exists"}


def test_numbered_without_rows(spark):
    assert U.numbered(spark.range(0), 5, ["id"]).collect() == []


# -- the log


def frames(spark, kinds, first=0, bad=()):
    return spark.createDataFrame([(first + i, k == "c", first + i not in bad, i) for i, k in enumerate(kinds)], "seq long, is_commit boolean, valid boolean, v int")


@pytest.mark.parametrize(("kinds", "bad", "want"), [("oocoocoo", (), {0: 3, 1: 3}), ("oocooc", (5,), {0: 3}), ("ooo", (), {}), ("c", (), {0: 1}), ("oocc", (), {0: 3, 1: 1})])
def test_groups(spark, kinds, bad, want):
    got = J.groups(J.valid_prefix(frames(spark, kinds, 1022, [1022 + b for b in bad]), 1022)).groupBy("group_id").count().collect()
    assert {r.group_id: r["count"] for r in got} == want
    commits = [i for i, k in enumerate(kinds) if k == "c" and (not bad or i < bad[0])]
    assert J.next_seq(J.valid_prefix(frames(spark, kinds, 1022, [1022 + b for b in bad]), 1022), 1022).first().next_seq == 1022 + (commits[-1] + 1 if commits else 0)


def test_gap_ends_the_prefix_and_the_ring_bounds_it(spark):
    f = frames(spark, "o" * 2000).filter("seq <> 9")
    assert J.valid_prefix(f, 0).count() == 9 and J.valid_prefix(f, 10).count() == 1024
    assert J.ring_slots(f).count() == 1024


def test_running_over_many_lots(spark):
    f = frames(spark, "ooc" * 1500)
    got = {r.seq: r.run for r in J.running(f, F.col("is_commit").cast("long")).collect()}
    assert got == {i: (i + 1) // 3 for i in range(4500)}


def test_replay_twice_changes_nothing(spark):
    ops = spark.createDataFrame([(1, 0, ROOT, 0, i, 65 + i, 8) for i in range(6)], EXTENT)
    log = frames(spark, "ooocoo").join(ops, "seq")
    once = J.replay(ops.limit(0), log, 0, ["ino", "off"])
    assert [r.data_block for r in once.collect()] == [67]
    assert J.replay(once, log, 0, ["ino", "off"]).collect() == once.collect()


# -- names


def tree(spark):
    inodes = spark.createDataFrame([(1, 16877, 2, 0, 0, ROOT), (2, 16877, 2, 0, 1, ROOT), (3, 33188, 2, 5000, 1, ROOT), (4, 33188, 1, 1, 2, 100)], "ino long, mode int, nlink long, size long, parent_ino long, snap_id long")
    dirents = spark.createDataFrame([(1, "ab", 2, 2, ROOT), (1, "abc", 3, 1, ROOT), (2, "x", 3, 1, ROOT), (2, "y", 4, 1, 100)], "parent_ino long, name string, target_ino long, file_kind int, snap_id long")
    return inodes, dirents


def test_listing_order_and_pages(spark):
    inodes, dirents = tree(spark)
    rows = N.readdir(dirents, inodes, 1).orderBy("place").collect()
    assert [(r.name, r.ino) for r in rows] == [(".", 1), ("..", 1), ("abc", 3), ("ab", 2)]
    assert [r.name for r in N.readdir_page(N.readdir(dirents, inodes, 1), 1, 2).orderBy("place").collect()] == ["..", "abc"]
    assert N.dangling(dirents, inodes.filter("ino <> 4")).count() == 1
    assert {r.ino: r.is_empty for r in N.dir_is_empty(dirents.filter("parent_ino = 1"), inodes).collect()} == {1: False, 2: True}


def test_unlink(spark):
    inodes, dirents = tree(spark)
    names = spark.createDataFrame([(2, "x"), (2, "y"), (1, "ab"), (1, "nope")], "parent_ino long, name string")
    got = {(r.table, r.ino, r.kind, r.nlink) for r in N.unlink(dirents, inodes, names, 100).collect()}
    assert got == {("dirent", 3, 2, None), ("inode", 3, 0, 1), ("dirent", 4, 1, None), ("inode", 4, 1, None), ("deleted_inode", 4, 0, None)}


def test_rename(spark):
    inodes, dirents = tree(spark)
    moves = spark.createDataFrame([(2, "x", 1, "z"), (2, "y", 1, "ab"), (1, "ab", 1, "ab"), (1, "no", 1, "q")], "parent_ino long, name string, new_parent long, new_name string")
    got = {(r.verdict, r.parent_ino, r.name, r.kind) for r in N.rename(dirents, moves, 100).collect()}
    assert got == {("ok", 2, "x", 2), ("ok", 1, "z", 0), ("already exists", 2, "y", None), ("already exists", 1, "ab", None), ("not found", 1, "no", None)}
    up = N.reparented(inodes, spark.createDataFrame([(2, 9)], "ino long, new_parent long"))
    assert up.filter("ino = 2").first().parent_ino == 9


def test_names(spark):
    names = ["", ".", "..", "a/b", "a\0b", "é" * 9 + "x", "é" * 10, "ok"]
    got = [r.p for r in spark.createDataFrame([(n,) for n in names], "n string").select(K.name_problem(F.col("n")).alias("p")).collect()]
    assert got == ["empty", "reserved", "reserved", "character", "character", None, "too long", None]


# -- bytes


def test_write_then_read(spark):
    blob = bytes(i % 251 for i in range(9000))
    old = spark.createDataFrame([(1, 4096, b"\xff" * 4000)], "ino long, off long, payload binary")
    cut = X.write_chunks(spark.createDataFrame([(1, 5000, bytearray(blob))], "ino long, start long, data binary"), old).collect()
    by = {r.off: bytes(r.payload) for r in cut}
    assert by[4096] == b"\xff" * 904 + blob[: 4096 - 904] and by[12288] == blob[7288:]
    rows = [(1, off, i + 65, len(p)) for i, (off, p) in enumerate(sorted(by.items()))]
    extents = spark.createDataFrame(rows, "ino long, off long, data_block long, len long")
    blocks = spark.createDataFrame([(r[2], bytearray(by[r[1]])) for r in rows], "block_nr long, payload binary")
    sizes = spark.createDataFrame([(1, 20_000)], "ino long, size long")
    reads = spark.createDataFrame([(1, 0, 99_999), (1, 4999, 3), (1, 20_000, 5), (2, 0, 5)], "ino long, start long, count long")
    got = {r.start: bytes(r.data) for r in X.read_bytes(X.read_segments(sizes, extents, reads), blocks).collect()}
    whole = (bytes(4096) + b"\xff" * 904 + blob).ljust(20_000, b"\0")
    assert got == {0: whole, 4999: whole[4999:5002]}


def test_gap_inside_a_block_is_zeros(spark):
    cut = X.write_chunks(spark.createDataFrame([(1, 10, bytearray(b"ab"))], "ino long, start long, data binary"), spark.createDataFrame([(1, 0, bytearray(b"xyz"))], "ino long, off long, payload binary"))
    assert bytes(cut.first().payload) == b"xyz" + bytes(7) + b"ab"


def test_truncate_keeps_inherited_blocks(spark):
    extents = spark.createDataFrame([(1, 0, 4096, ROOT), (1, 4096, 4096, ROOT), (1, 8192, 10, 100), (2, 8192, 10, 100)], "ino long, off long, len long, snap_id long")
    got = {(r.off, r.new_len, r.kind, r.frees) for r in X.truncate(extents, spark.createDataFrame([(1, 4000)], "ino long, size long"), 100).collect()}
    assert got == {(0, 4000, 0, False), (4096, 0, 2, False), (8192, 0, 1, True)}


# -- durable store and stream


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    base = spark.createDataFrame([(1, 0, ROOT, 0, 0, 65, 8)], EXTENT)
    store = Store.create(spark, path, base, ["ino", "off"])
    with pytest.raises(E.AlreadyExists):
        Store.create(spark, path, base, ["ino", "off"])
    with pytest.raises(E.NotFound):
        Store.open(spark, f"{path}-none")
    other = Store.open(spark, path)
    store.commit(spark.createDataFrame([(1, 0, ROOT, 0, store.next_seq, 66, 8)], EXTENT))
    with pytest.raises(E.AlreadyExists):
        other.commit(base)  # a second writer loses
    store.commit(spark.createDataFrame([(1, 4096, ROOT, 0, store.next_seq, 67, 8)], EXTENT))
    again = Store.open(spark, path)
    state = lambda s: sorted((r.off, r.data_block) for r in J.newest(s.entries(), ["ino", "off"]).collect())
    assert again.state == store.state and state(again) == [(0, 66), (4096, 67)]
    again.checkpoint()
    assert state(again) == [(0, 66), (4096, 67)] and again.entries().count() == 2
    last = tmp_path / "t" / "manifests" / f"{again.state['number']:020d}.json"
    last.write_text(last.read_text()[:40])  # cut off: the one before it holds
    (tmp_path / "t" / "manifests" / f".{last.name}.crc").unlink(missing_ok=True)
    assert Store.open(spark, path).state["number"] == again.state["number"] - 1
    assert "base-0" in again.vacuum()


def test_stream_into_store(spark, tmp_path):
    rows = spark.createDataFrame([(1, 4096 * i, ROOT, 0, i + 1, 65 + i, 8) for i in range(10)], EXTENT)
    store = Store.create(spark, f"file://{tmp_path}/t", rows.limit(0), ["ino", "off"])
    rows.filter("seq <= 5").write.parquet(f"{tmp_path}/log/a")
    log = tail.follow(spark, f"{tmp_path}/log/*", rows.schema)
    tail.into_store(log, store, f"{tmp_path}/c", rows.columns).awaitTermination()
    assert store.entries().count() == 5
    rows.filter("seq > 5").write.parquet(f"{tmp_path}/log/b")
    tail.into_store(tail.follow(spark, f"{tmp_path}/log/*", rows.schema), store, f"{tmp_path}/c", rows.columns).awaitTermination()
    assert store.entries().count() == 10 and store.next_seq == 11


def test_windowed_counts_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:10", 0, 1), ("2024-01-01 00:00:50", 0, 2), ("2024-01-01 00:02:00", 2, 3)], "ts string, kind int, seq long").selectExpr("to_timestamp(ts) AS ts", "kind", "seq").write.parquet(f"{tmp_path}/f")
    frames = tail.follow(spark, f"{tmp_path}/f", spark.read.parquet(f"{tmp_path}/f").schema)
    q = tail.counts(frames, "ts", "1 minute", "10 seconds").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.kind, r.n, r.top_seq) for r in spark.table("windows").collect()) == [(0, 2, 2), (2, 1, 3)]


def test_adapters_have_the_tree(spark):
    assert {r.snap_id for r in A.snapshots(spark).collect()} == set(range(4294967289, ROOT + 1))


# -- refusals, handlers, transactions, recovery


def test_delete_is_refused(spark):
    snaps = spark.createDataFrame([(ROOT, 0, 0), (9, ROOT, 1), (8, 9, 1)], "snap_id long, parent_id long, flags int")
    vols = spark.createDataFrame([(1, ROOT, 0, 0), (2, 9, 1, 1), (3, 8, 1, 1), (4, 8, 0, 1)], "subvol_id long, snap_id long, flags int, parent_subvol long")
    for subvol, error in ((1, E.Invalid), (2, E.Busy), (4, E.Invalid), (9, E.NotFound)):
        with pytest.raises(error):
            S.delete(snaps, vols, 3, subvol)
    with pytest.raises(E.Busy):
        S.delete(snaps, vols, 3, 3)
    assert S.switch_subvol(vols, 2) == 9
    with pytest.raises(E.NotFound):
        S.switch_subvol(vols, 7)


def test_read_own_writes_and_abort(spark):
    rows = [(1, 0, ROOT, 0, 1, 65, 8), (2, 0, ROOT, 0, 2, 66, 8)]
    session = Session.memory(spark.createDataFrame(rows, EXTENT), ["ino", "off"])
    new = spark.createDataFrame([(3, 0, 70, 8)], "ino long, off long, data_block long, len long")
    line = [100, ROOT]
    with session.transaction() as tx:
        tx.put(new, 100)
        assert tx.find_at(F.col("ino") == 3, 100).count() == 1 and session.entries().count() == 2
        tx.delete(new.union(spark.createDataFrame([(1, 0, 0, 0)], new.schema)), line)
        assert tx.find_visible(F.lit(True), line).select("ino").collect() == [(2,)]
    kinds = {(r.ino, r.snap_id): r.kind for r in session.drain()[0].collect()}
    assert kinds == {(3, 100): K.DELETED, (1, 100): K.WHITEOUT} and session.drain() == []
    before = session.next_seq
    with pytest.raises(ValueError), session.transaction() as tx:
        tx.put(new, 100)
        raise ValueError
    assert session.next_seq == before and session.entries().count() == 4
    with session.transaction() as tx:
        tx.put(new, 100)
        tx.put(new, 7)
        tx.truncate(1)
    assert [r.snap_id for r in session.log[0].collect()] == [100]


def test_log_goes_into_a_store(spark, tmp_path):
    entries = spark.createDataFrame([(1, 0, ROOT, 0, 1, 65, 8)], EXTENT)
    store = Store.create(spark, f"file://{tmp_path}/s", entries, ["ino", "off"])
    ops = spark.createDataFrame([(i, 0, ROOT, 0, 100 + i, 8) for i in range(3)], "ino long, off long, snap_id long, kind int, data_block long, len long")
    frames, after, due = J.commit(ops, 0, 0, ["ino"])
    assert after == 4 and not due and J.commit(ops, 960, 0, ["ino"])[2]
    torn = frames.union(frames.filter("not is_commit").withColumn("seq", F.col("seq") + 4))
    assert store.recover(torn) == 3 and Store.open(spark, store.path).recover(torn) == 0
    store = Store.open(spark, store.path)
    assert store.state["journal_seq"] == 4 and store.entries().count() == 4
    other = Store.open(spark, store.path)
    store.commit(entries)
    with pytest.raises(E.AlreadyExists):
        other.commit(entries)
    with Session.over(store).transaction() as tx:
        tx.put(spark.createDataFrame([(9, 0, 1, 1)], "ino long, off long, data_block long, len long"), ROOT)
    assert Store.open(spark, store.path).entries().filter("ino = 9").count() == 1
    store.vacuum()
    assert Store.open(spark, store.path).entries().count() == 6


def test_frames_hold(spark):
    row = spark.sql("SELECT X'0102' AS k, X'' AS v, X'05AA' AS short")
    data = K.encoded_record(F.col("k"), F.col("v"))
    got = row.select(data.alias("d"), K.decoded_record(data).alias("r"), K.decoded_record(F.col("short")).alias("s"), K.decoded_record(F.col("v")).alias("e")).first()
    assert bytes(got.d) == b"\x02\x01\x02" and bytes(got.r.key) == b"\x01\x02" and bytes(got.r.value) == b"" and got.s is None and got.e is None
    op, zero = F.lit(K.FRAME_OP), F.lit(0)
    crc = F.crc32(K.frame_bytes(F.lit(7), op, zero, data))
    check = lambda seq, kind, sum_: row.select(K.frame_valid(sum_, F.lit(7), F.lit(seq), kind, zero, data).alias("x")).first().x
    assert check(7, op, crc) and not check(8, op, crc) and not check(7, F.lit(9), crc) and not check(7, op, crc + 1)


def test_handlers_edge_cases(spark):
    names = spark.createDataFrame([(1, "a", 5, 1, ROOT)], "parent_ino long, name string, target_ino long, file_kind int, snap_id long")
    ask = lambda *rows: spark.createDataFrame(rows, "req long, parent_ino long, name string, file_kind int, mode int, uid int, gid int, target string")
    got = {r.req: (r.verdict, r.ino, r.size) for r in N.make(names, ask((2, 1, "l", 3, 0, 0, 0, "é"), (1, 1, "l", 1, 0o7644, 0, 0, None), (3, 1, "x", 3, 0, 0, 0, "t" * 4097), (4, 1, None, 1, 0, 0, 0, None), (5, 2, "l", 3, 0, 0, 0, "é")), 50, 1).collect()}
    assert got == {1: ("ok", 50, 0), 2: ("already exists", None, None), 3: ("invalid: target too long", None, None), 4: ("invalid: empty", None, None), 5: ("ok", 51, 2)}
    assert N.make(names, ask().limit(0), 50, 1).count() == 0
    nodes = spark.createDataFrame([(5, 0o120777, 1, 9, 1)], "ino long, mode int, nlink long, size long, parent_ino long")
    links = spark.createDataFrame([(1, 5, 1, "b"), (2, 5, 2, "b"), (3, 5, 1, "a")], "req long, ino long, parent_ino long, name string")
    assert {(r.req, r.verdict, r.nlink, r.file_kind) for r in N.link(names, nodes, links, 1).collect()} == {(1, "ok", 3, 3), (2, "ok", 3, 3), (3, "already exists", None, None)}
    assert [tuple(r) for r in N.readlink(nodes, nodes).collect()] == [(5, "ok", 0, 9)]

