"""What several operators share: the folder all executors see, staging and table access."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from palimpsest.sources.staging import staged

_shipped: set[str] = set()

#: Rows that a Python worker gets at a time. Texts may be long, and an executor runs several workers.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application: their Python need not have it installed. And let
    batches be no larger than BATCH_ROWS, if the session leaves that at more."""
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="palimpsest-"), "palimpsest.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def lean(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """run, giving memory that it no longer uses back to the system when its task ends: an executor keeps several
    Python workers, and what their allocators hold back would add up over stages."""

    def task(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
                trim(0)

    return task


def free(name: str, taken: list[str]) -> str:
    """A column name like `name` that is not among those taken, in whatever case."""
    used = {c.lower() for c in taken}
    name = f"__{name}"
    while name.lower() in used:
        name += "_"
    return name


def swept(spark: SparkSession) -> None:
    """Have the shuffle files of steps that are over deleted now. Spark deletes them when the driver happens to collect
    its garbage, so on disk they would add up with those of the next steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """staged(), with this package sent to the executors."""
    ship(df.sparkSession)
    return staged(df, label, **options)
