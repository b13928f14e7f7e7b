import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import keys as K
from palimpsest.operators import chain as C
from palimpsest.operators import snapshot as S
from palimpsest.operators import maintain as M
from palimpsest.operators import mutate as U
from palimpsest.operators import visible as V
from palimpsest.operators.errors import Invalid

ROOT = K.ROOT_SNAP
SCHEMA = "k string, snap_id long, kind int, seq long, v string"


def entries(spark, rows):
    return spark.createDataFrame([(*r[:2], r[2], i, *r[3:]) for i, r in enumerate(rows)], SCHEMA)


def seen(df, chain):
    return {r.k: (r.v, r.snap_id) for r in V.visible(df, ["k"], chain).collect()}


@pytest.mark.parametrize(
    ("rows", "chain", "want"),
    [
        ([("K", ROOT, 0, "root"), ("K", 100, 0, "own")], [100, ROOT], {"K": ("own", 100)}),
        ([("K", ROOT, 0, "root"), ("K", 100, 0, "own")], [80, ROOT], {"K": ("root", ROOT)}),
        ([("K", ROOT, 0, "root"), ("K", 80, 2, None)], [80, ROOT], {}),
        ([("K", ROOT, 0, "root"), ("K", 80, 2, None)], [ROOT], {"K": ("root", ROOT)}),
        ([("K", 100, 0, "x"), ("K", 100, 1, None), ("K", ROOT, 0, "root")], [50, 100, ROOT], {}),
        ([("K", 100, 1, None), ("K", 100, 0, "back")], [100, ROOT], {"K": ("back", 100)}),
        ([("ab", ROOT, 0, "short"), ("abc", ROOT, 0, "long")], [ROOT], {"ab": ("short", ROOT), "abc": ("long", ROOT)}),
        ([("K", 200, 0, "side")], [100, ROOT], {}),
        ([], [ROOT], {}),
    ],
)
def test_visibility(spark, rows, chain, want):
    assert seen(entries(spark, rows), chain) == want


def test_prefix_keys_between_versions(spark):
    # The bytes of a longer key may sort between two versions of a shorter one.
    rows = [("ab", 100, 2, None), ("abc", ROOT, 0, "long"), ("ab", ROOT, 0, "short")]
    assert seen(entries(spark, rows), [100, ROOT]) == {"abc": ("long", ROOT)}


def test_bounds_are_on_sortable_bytes(spark):
    df = spark.createDataFrame([(b"ab", ROOT), (b"abc", ROOT), (b"abd", 5)], "k binary, s long")
    inside = lambda a, b: {bytes(r.k) for r in df.filter(K.in_byte_range(K.sortable(F.col("k"), F.col("s")), F.lit(a), F.lit(b))).collect()}
    assert inside(b"abc", b"b") == {b"ab", b"abc", b"abd"}
    assert inside(b"a", b"abc") == set()


def test_delete_dispatch(spark):
    df = entries(spark, [("own", 100, 0, "a"), ("up", ROOT, 0, "b"), ("gone", 100, 1, None)])
    targets = spark.createDataFrame([("own",), ("up",), ("gone",), ("none",)], "k string")
    got = {r.k: (r.kind, r.deleted) for r in U.delete_resolve(df, targets, ["k"], [100, ROOT]).collect()}
    assert got == {"own": (1, True), "up": (2, True), "gone": (None, False), "none": (None, False)}
    delta = U.delete_delta(df, targets, ["k"], [100, ROOT], 50)
    assert seen(df.unionByName(delta), [100, ROOT]) == {} and seen(df.unionByName(delta), [ROOT]) == {"up": ("b", ROOT)}


def test_batch_is_checked(spark):
    with pytest.raises(Invalid):
        U.checked_batch(entries(spark, [("a", 1, 0, "x"), ("a", 1, 0, "y")]), ["k"])


def test_compaction(spark):
    df = entries(spark, [("K", ROOT, 0, "r"), ("K", 100, 0, "x"), ("K", 100, 1, None), ("K", 80, 2, None), ("L", 80, 0, "old"), ("L", 80, 2, None)])
    kept = {(r.k, r.snap_id, r.kind) for r in M.compact_whiteouts(df, ["k"], [80, 100]).collect()}
    assert kept == {("K", ROOT, 0), ("K", 100, 1)}  # the older copy of L doesn't come back
    assert {(r.k, r.snap_id) for r in M.drop_snapshot_keys(df, ["k"], [80]).collect()} == {("K", ROOT), ("K", 100)}
    assert M.compact_whiteouts(df, ["k"], []).count() == V.newest(df, ["k"]).count()


def test_sweep_is_exact(spark):
    rows = [(1, 0, ROOT, 0, i, 65 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "ino long, off long, snap_id long, kind int, seq long, data_block long")
    assert M.gc_sweep(df, ["ino", "off"], None, 115).count() == 49


def test_filter_reaches_the_scan(spark, tmp_path):
    entries(spark, [("K", ROOT, 0, "x")]).write.parquet(str(tmp_path / "e"))
    plan = V.visible(spark.read.parquet(str(tmp_path / "e")), ["k"], [100, ROOT])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(snap_id" in plan and plan.count("Exchange hashpartitioning") == 1


def test_random_operations_against_a_model(spark):
    """Puts, deletes and snapshots in turn; every branch is looked at after each batch."""
    rnd = random.Random(11)
    snaps, heads, low, seq = [(ROOT, 0, 0)], {1: ROOT}, ROOT, 0
    log, model = [], {1: {}}
    for _ in range(6):
        if rnd.random() < 0.6 and len(heads) < 4:
            src = rnd.choice(list(heads))
            snaps += [(low - 1, heads[src], 0), (low - 2, heads[src], 0)]
            new = max(heads) + 1
            heads[src], heads[new], low = low - 1, low - 2, low - 2
            model[new] = dict(model[src])
        frame = spark.createDataFrame(snaps, "snap_id long, parent_id long, flags int")
        for who, head in heads.items():
            line = C.chain(frame, head)
            df = spark.createDataFrame(log, SCHEMA)
            assert {k: v for k, (v, _) in seen(df, line).items()} == model[who]
        who = rnd.choice(list(heads))
        line = C.chain(frame, heads[who])
        state = spark.createDataFrame(log, SCHEMA)
        keys = rnd.sample("abcdefghij", 5)
        gone = spark.createDataFrame([(k,) for k in keys[:2]], "k string")
        for r in U.delete_delta(state, gone, ["k"], line, seq).collect():
            log.append(tuple(r))
        for k in keys[:2]:
            model[who].pop(k, None)
        seq += 10
        for k in keys[2:]:
            log.append((k, heads[who], 0, seq, f"{k}{seq}"))
            model[who][k] = f"{k}{seq}"
            seq += 1


def test_ancestors(spark):
    snaps = spark.createDataFrame([(ROOT, 0, 0), (100, ROOT, 0), (80, 100, 0), (60, ROOT, 0)], "snap_id long, parent_id long, flags int")
    assert C.chain(snaps, 80) == [80, 100, ROOT] and C.chain(snaps, 7) == [7]
    pairs = spark.createDataFrame([(ROOT, 80), (80, 80), (60, 80), (80, ROOT)], "ancestor long, of long")
    assert {(r.ancestor, r.of): r.is_ancestor for r in C.is_ancestor(snaps, pairs).collect()} == {(ROOT, 80): True, (80, 80): True, (60, 80): False, (80, ROOT): False}


def test_scans_need_no_sort(spark, tmp_path):
    rows = [(1, 0, ROOT, 0, 1, 65)]
    spark.createDataFrame(rows, "ino long, off long, snap_id long, kind int, seq long, data_block long").write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    for out in (V.visible(df, ["ino", "off"], [100, ROOT]), V.newest(df, ["ino", "off"]), V.view_diff(df, ["ino", "off"], [100, ROOT], [ROOT], ["data_block"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and plan.count("FileScan") == 1


def test_views_differ(spark):
    rows = [(1, ROOT, 0, 1, 10), (1, 100, 0, 2, 11), (2, ROOT, 0, 3, None), (2, 100, 2, 4, None), (3, ROOT, 0, 5, 12), (4, 100, 0, 6, None), (5, 100, 1, 7, 1), (6, ROOT, 0, 8, 5), (6, 100, 0, 9, 5)]
    df = spark.createDataFrame(rows, "k long, snap_id long, kind int, seq long, v long")
    got = {tuple(r) for r in V.view_diff(df, ["k"], [100, ROOT], [ROOT], ["v"]).collect()}
    assert got == {(1, 11, 10), (2, None, None), (4, None, None)}


def test_a_deep_tree(spark):
    """Every operator on a chain of 5,000 snapshots with a side branch near its end."""
    n = 5000
    snaps = spark.range(n).select((F.lit(ROOT) - F.col("id")).alias("snap_id"), F.when(F.col("id") == 0, 0).otherwise(F.lit(ROOT) - F.col("id") + 1).cast("long").alias("parent_id"), F.lit(1).alias("flags"))
    side, low = ROOT - n, ROOT - n + 1
    snaps = snaps.union(spark.createDataFrame([(side, ROOT - 3, 1)], "snap_id long, parent_id long, flags int"))
    vols = spark.createDataFrame([(1, ROOT, 0, 0), (2, low, 1, 1), (3, ROOT - 40, 1, 1)], "subvol_id long, snap_id long, flags int, parent_subvol long")
    assert C.chain(snaps, low) == list(range(low, ROOT + 1)) and C.chain(snaps, side) == [side, *range(ROOT - 3, ROOT + 1)]
    own = C.closure(snaps, vols.filter("subvol_id = 2"))
    assert own.agg(F.count("*"), F.max("depth")).first() == (n, n - 1)
    pairs = spark.createDataFrame([(ROOT, low), (ROOT - 2500, low), (low, ROOT), (ROOT - 4, side), (ROOT - 3, side)], "ancestor long, of long")
    assert {(r.ancestor, r.of): r.is_ancestor for r in C.is_ancestor(snaps, pairs).collect()} == {(ROOT, low): True, (ROOT - 2500, low): True, (low, ROOT): False, (ROOT - 4, side): False, (ROOT - 3, side): True}
    assert {(r.subvol_id, r.has_child, r.has_dependent) for r in S.busy(snaps, vols).collect()} == {(1, True, True), (2, False, False), (3, True, True)}
    assert [r.snap_id for r in S.unreferenced(snaps, vols).collect()] == [side]
    assert {r.verdict for r in S.delete_check(snaps, vols, 1, vols.filter("subvol_id > 1")).collect()} == {"ok", "busy: child"}
