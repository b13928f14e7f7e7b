"""Following a log of deltas with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from palimpsest.sources.store import Store


def follow(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Frames as they are added to a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def counts(frames: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Frames of each kind in windows of time; frames later than `late` are left out."""
    return frames.withWatermark(time, late).groupBy(F.window(time, width), "kind").agg(F.count("*").alias("n"), F.max("seq").alias("top_seq"))


def into_store(frames: DataFrame, store: Store, checkpoint: str, columns: Sequence[str], on_commit: Callable[[int], None] | None = None) -> StreamingQuery:
    """Each batch as one commit. A batch that is run again brings the same seqs, which change nothing."""

    def commit(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.commit(batch.select(*columns))
        if on_commit:
            on_commit(number)

    return frames.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
