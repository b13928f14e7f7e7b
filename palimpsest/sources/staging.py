"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is spark.checkpoint.dir where the cluster names one. Only where none is set, as in local
    tests, a temporary folder is made and set, once a session.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, so that a lost
    executor costs no more than its running tasks, and no later job repeats the work. The folders
    are deleted when the driver ends. options: of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session has ended: the cluster's own cleaning remains
            return
