"""Approximate nearest neighbours by a hash-prefix forest.

A tree is the sorted array of the rows' hash strings (64 random hyperplanes, a bit each). A query descends in each
tree to the rows that share the longest prefix with its own string, then ascends in all trees at once, a bit
at a time, until the union of what it has met is `share` of the index; those candidates are scored exactly.
Rows whose strings are equal in all trees count once towards it, so a hot group does not use up the share.
Vectors without structure need a large share (see the README for the recall measured).

The index is dealt into shards of a bounded number of rows, each with its own forest, and the queries into
blocks; each block visits each shard, and a query's best of all shards are its answer. Every row is indexed.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
another length are not compared; equal scores go to the smaller id, so many equal vectors are no special
case; rows of the query's own id are not its neighbours; fewer rows than asked for are all returned; an empty
table gives no rows; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import lean, ship, stage, table

TREES = 32
DEPTH = 64
SHARE = 0.8
SHARD_ROWS = 8192
BLOCK_QUERIES = 1024
SEED = 20_240_229
#: For each prefix length from 0 to DEPTH, the bits of a string after it.
_REST = np.array([(1 << (DEPTH - d)) - 1 for d in range(DEPTH + 1)], dtype=np.uint64)


def hashes(vectors: np.ndarray, trees: int) -> np.ndarray:
    """[tree, row] strings of DEPTH bits, the first bit highest."""
    rnd = np.random.default_rng(SEED + vectors.shape[1])
    out = np.zeros((trees, len(vectors)), dtype=np.uint64)
    for t in range(trees):
        bits = vectors @ rnd.standard_normal((vectors.shape[1], DEPTH)) > 0
        out[t] = np.packbits(bits, axis=1).view(">u8").reshape(-1)
    return out


class Forest:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        strings = hashes(vectors, trees)
        # Rows of equal strings enter together: the first of each class stands for it where rows are counted.
        self.first = np.zeros(len(ids), dtype=bool)
        self.first[np.unique(strings.T, axis=0, return_index=True)[1]] = True
        self.classes = int(self.first.sum())
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.strings = np.take_along_axis(strings, self.order, axis=1)

    def candidates(self, query: np.ndarray, wanted: int) -> np.ndarray:
        """Rows met by descent and synchronous ascent, at least `wanted` classes where there are as many. query: its strings."""
        met, n = np.zeros(len(self.ids), dtype=bool), len(self.ids)
        if wanted >= self.classes:
            return np.arange(n)
        # [tree, depth] bounds of the rows that share a prefix of that length with the query.
        lo = np.stack([np.searchsorted(s, q & ~_REST) for s, q in zip(self.strings, query, strict=True)])
        hi = np.stack([np.searchsorted(s, q | _REST, side="right") for s, q in zip(self.strings, query, strict=True)])
        grown = (lo[:, :-1] != lo[:, 1:]) | (hi[:, :-1] != hi[:, 1:])
        for depth in range(DEPTH, -1, -1):
            for t in range(len(query)) if depth == DEPTH else np.flatnonzero(grown[:, depth]):
                if depth == DEPTH:
                    met[self.order[t, lo[t, depth] : hi[t, depth]]] = True
                else:
                    met[self.order[t, lo[t, depth] : lo[t, depth + 1]]] = True
                    met[self.order[t, hi[t, depth + 1] : hi[t, depth]]] = True
            if (depth == DEPTH or grown[:, depth].any()) and np.count_nonzero(met & self.first) >= wanted:
                break
        return np.flatnonzero(met)

    def search(self, query_id: int, query: np.ndarray, strings: np.ndarray, k: int, share: float) -> list[tuple[int, float]]:
        at = self.candidates(strings, max(k + 1, int(np.ceil(share * self.classes))))
        at = at[self.ids[at] != query_id]
        # Row by row, so that equal vectors have equal scores wherever they stand.
        scores = (self.vectors[at] * query).sum(axis=1) / (self.norms[at] * np.sqrt((query * query).sum()))
        best = np.lexsort((self.ids[at], -scores))[:k]
        return list(zip(self.ids[at][best].tolist(), scores[best].tolist(), strict=True))


def _common(a: np.uint64, b: np.uint64) -> int:
    return DEPTH - int(a ^ b).bit_length()


def _packed(rows: DataFrame, parts: int) -> DataFrame:
    """(dim, part, ids, vectors): the rows of a part as two binaries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def one() -> pa.RecordBatch:
            ids, vectors = np.array([i for i, _ in held], dtype="<i8"), np.array([v for _, v in held], dtype="<f8")
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["dim", "part", "ids", "vectors"])

        for batch in batches:
            for i, v, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key and held:
                    yield one()
                    held = []
                key = own
                held.append((i, v))
        if held:
            yield one()

    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    dealt = rows.select("id", "v", F.size("v").alias("dim"), part.alias("part")).repartition(parts, "dim", "part").sortWithinPartitions("dim", "part", "id")
    return dealt.mapInArrow(lean(run), "dim int, part int, ids binary, vectors binary")


def search(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, trees: int = TREES, share: float = SHARE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found among `vectors`."""

    ship(vectors.sparkSession)
    def usable(df: DataFrame) -> DataFrame:
        v = F.col("v")
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        some = F.exists(v, lambda x: x != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(v.isNotNull() & F.col("id").isNotNull() & ~bad & some)

    rows, asked = usable(vectors), usable(queries)
    shards, blocks = rows.count() // shard_rows + 1, asked.count() // BLOCK_QUERIES + 1
    index = stage(_packed(rows, shards), "index")
    lots = _packed(asked, blocks).select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("part"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, forest = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, data, q_ids, q = (batch.column(c)[i].as_py() for c in range(5))
                if held != (dim, ids):
                    forest, held = Forest(np.frombuffer(ids, "<i8"), np.frombuffer(data, "<f8").reshape(-1, dim), trees), (dim, ids)
                asks = np.frombuffer(q, "<f8").reshape(-1, dim)
                strings, out = hashes(asks, trees), []
                for j, query_id in enumerate(np.frombuffer(q_ids, "<i8").tolist()):
                    out += [(query_id, *found) for found in forest.search(query_id, asks[j], strings[:, j], k, share)]
                cols = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    # One row a shard and block: the smaller side of this join is not broadcast, as both grow with the data.
    met = index.hint("merge").join(lots, ["dim", "part"]).select("dim", "ids", "vectors", "q_ids", "q").mapInArrow(lean(run), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 50 = 0"))
