import glob
import os

import duckdb
import pytest

import __spark_entry__
from palimpsest.plans import queries as Q

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return db


def plain(x):
    return x.hex() if isinstance(x, bytes | bytearray) else round(x, 9) if isinstance(x, float) else x


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are absent")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    cursor = duck.execute(Q.SQL[name])
    at = [c[0] for c in cursor.description]
    assert sorted(at) == cols
    order = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted((tuple(plain(r[at.index(c)]) for c in cols) for r in cursor.fetchall()), key=order)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=order) == want


def test_every_query_has_its_name():
    assert set(Q.QUERIES) == set(Q.SQL) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are absent")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are absent")
def test_whole_tables_are_targets(spark):
    extents, names = Q.A.extents(spark, FOLDER), Q._names(spark, FOLDER)
    seen = Q.V.visible(extents, Q.KEY, Q._chain(spark))
    assert Q.QUERIES["delete_resolve"](spark, FOLDER).count() == extents.select(*Q.KEY).distinct().count()
    assert Q.QUERIES["lookup_attr"](spark, FOLDER).count() == names.count()
    assert Q.QUERIES["unlink"](spark, FOLDER).filter("table = 'dirent'").count() == names.filter("file_kind = 1").count()
    assert Q.QUERIES["truncate"](spark, FOLDER).count() == seen.filter("off + len > 10000").count()
    root = Q.QUERIES["journal_replay"](spark, FOLDER).filter(f"snap_id = {Q.ROOT}")
    assert extents.filter(f"snap_id = {Q.ROOT}").join(root, Q.KEY, "left_anti").count() == 0
