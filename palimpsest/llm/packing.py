"""Packing into optimal length buckets.

Lengths in tokens are counted over all documents; dynamic programming over the global histogram finds the
bucket boundaries that make the least padding (each document is padded to its bucket's boundary); inside a
bucket, documents in ascending order fill batches of a token budget.

Cases: a null or empty text has the end token alone; a document above the budget is a batch of its own and
is never cut; equal lengths share a bucket; an empty table has no buckets and no rows; repeated ids are
packed one by one; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import tokens
from palimpsest.llm.common import lean, ship, stage, table

BUCKETS = 16
#: Padded tokens of a batch.
BUDGET = 65_536
#: Documents that are numbered by one task at a time, about.
NUMBERED = 50_000


def token_counts(docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens), the end token included; text stays where it is."""
    ship(docs.sparkSession)
    path = tokenizer or tokens.default_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        size = encoder.dtype.itemsize
        for batch in batches:
            n = [len(encoder.encode(t.as_py())) // size + 1 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, n_tokens long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The last length of each bucket, at most `buckets`, with the least padding over the histogram.

    best[k][j] = min over i of best[k-1][i] + cost(i, j), where cost(i, j) pads lengths i..j-1 to the
    (j-1)-th. cost fulfils the quadrangle inequality, so the best i never falls as j grows, and each layer
    takes a divide and conquer of m log m steps.
    """
    m = len(lengths)
    if not m:
        return []
    docs = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    total = np.concatenate(([0], np.cumsum(lengths * counts, dtype=np.int64)))
    best = lengths * docs[1:] - total[1:]
    best = np.concatenate(([0], best))
    froms = []
    for k in range(2, min(buckets, m) + 1):
        new, come = best.copy(), np.zeros(m + 1, dtype=np.int64)
        stack = [(k, m, k - 1, m - 1)]
        while stack:
            a, b, lo, hi = stack.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(lo, min(hi, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (docs[j] - docs[i]) - (total[j] - total[i])
            at = int(cost.argmin())
            new[j], come[j] = cost[at], lo + at
            stack += [(a, j - 1, lo, lo + at), (j + 1, b, lo + at, hi)]
        best = new
        froms.append(come)
    ends, j = [], m
    for come in reversed(froms):
        ends.append(int(lengths[j - 1]))
        j = int(come[j])
    ends.append(int(lengths[j - 1]))
    return ends[::-1]


def pack(counted: DataFrame, *, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(id, n_tokens) -> id, n_tokens, bucket, bucket_tokens, batch, slot, padding.

    `counted` is read three times, so it should be a written table. The driver gets the histogram: its
    distinct lengths are at most the square root of twice all tokens, as they add up to no more.
    """
    hist = counted.groupBy("n_tokens").count().toPandas().sort_values("n_tokens")
    ends = boundaries(hist["n_tokens"].to_numpy(np.int64), hist["count"].to_numpy(np.int64), buckets) or [1]
    salts = int(hist["count"].sum()) // NUMBERED + 1
    bucket = sum((F.col("n_tokens") > e).cast("int") for e in ends[:-1]) if len(ends) > 1 else F.lit(0)
    placed = counted.select(F.col(id_col), "n_tokens", bucket.alias("bucket"))
    # A bucket may hold most documents, so it is numbered in `salts` parts, cut by the hash of the id and
    # the row's own place in its part.
    placed = placed.withColumn("part", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)))
    sizes = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    row = F.row_number().over(Window.partitionBy("bucket", "part").orderBy(id_col, "n_tokens"))
    at = F.array(*[F.lit(e) for e in ends])[F.col("bucket")]
    fits = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_tokens")))
    return (
        placed.withColumn("row", row)
        .join(sizes, ["bucket", "part"])
        .withColumn("bucket_tokens", at.cast("long"))
        .withColumn("place", F.col("first") + F.col("row") - 1)
        .select(
            id_col, "n_tokens", "bucket", "bucket_tokens",
            F.floor(F.col("place") / fits).alias("batch"),
            (F.col("place") % fits).alias("slot"),
            (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
        )
    )


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stage(token_counts(table(spark, sf_dir, "documents")), "lengths"))
