"""Token-id files of directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level k holds the k-th chunks of the ids that have one,
one after another, beside a bitmap that says which of them go on in level k+1 and a rank directory
(ones before every 512th bit). Token i's first chunk stands at i, its next at rank(i) in the next level,
and so on: any token is read without decoding others, and the tokens i..j of a document are one slice of
each level.

A segment (one binary value) is, all little-endian: the magic, five u64 (documents, tokens, levels, 0, 0),
the documents' first tokens (u64, one more than documents), their ids (i64, and a byte each that is 1 for
null), and for each level u64 chunks, the chunks, the bitmap in u64 words and the directory in u64.
Segments are written by Spark as rows of a Parquet table, which any file system that Spark reaches can
hold and whose commit survives lost executors; export_segments() writes them as plain files.

Cases: null and empty texts have the end id alone; a null id sorts first; repeated ids stand in the order
of their texts; an empty table gives no segment; a text is never cut, however long; only the named columns
are read, so further columns cannot clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import tokens
from palimpsest.llm.common import lean, ship, stage, table

MAGIC = b"PALDAC01"
#: A segment ends with the document that brings it to so many tokens.
SEGMENT_TOKENS = 1 << 18
RANK_BITS = 512
_HEAD = struct.Struct("<8s5Q")


def _level(chunks: np.ndarray, more: np.ndarray) -> bytes:
    bits = np.packbits(more, bitorder="little").tobytes()
    bits += bytes(-len(bits) % (RANK_BITS // 8))
    ones = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).reshape(-1, RANK_BITS).sum(axis=1, dtype=np.uint64)
    ranks = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(ones, dtype=np.uint64)))
    return struct.pack("<Q", len(chunks)) + chunks.tobytes() + bits + ranks.astype("<u8").tobytes()


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    starts = np.concatenate(([0], np.cumsum(lengths))).astype("<u8")
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        levels.append(_level((rest & 0xFF).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> 8
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(levels), 0, 0)
    keys = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + bytes(d is None for d in doc_ids)
    return head + starts.tobytes() + keys + b"".join(levels)


class Segment:
    """Random access to a segment's bytes (or a memory map of them)."""

    def __init__(self, data: bytes):
        magic, self.n_docs, self.n_tokens, n_levels, _, _ = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = _HEAD.size

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, dtype=dtype, count=n, offset=at)
            at += got.nbytes
            return got

        self.starts = take("<u8", self.n_docs + 1)
        ids, null = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            blocks = -(-n // RANK_BITS)
            self.levels.append((take("u1", n), take("u1", blocks * RANK_BITS // 8), take("<u8", blocks + 1)))

    @staticmethod
    def _rank(level: tuple[np.ndarray, np.ndarray, np.ndarray], i: int) -> int:
        """Ones before bit i."""
        _, bits, ranks = level
        block, rest = divmod(i, RANK_BITS)
        if not rest:
            return int(ranks[block])
        at = block * RANK_BITS // 8
        return int(ranks[block]) + int(np.unpackbits(bits[at : at + (rest + 7) // 8], bitorder="little")[:rest].sum())

    def token(self, i: int) -> int:
        value = 0
        for k, level in enumerate(self.levels):
            value |= int(level[0][i]) << 8 * k
            if not level[1][i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Tokens a..b-1: one slice of each level, placed by the bits of the one before."""
        out = np.zeros(b - a, dtype=np.uint32)
        at = np.arange(b - a)
        for k, level in enumerate(self.levels):
            if a >= b:
                break
            out[at] |= level[0][a:b].astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(level[1][a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a]
            at = at[more.astype(bool)]
            a = self._rank(level, a)
            b = a + len(at)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


def segments(docs: DataFrame, path: str, *, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, start_in_part, n_tokens, segment), part by part in ascending order of documents."""
    schema = "part int, start_in_part long, n_tokens long, segment binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, start = tokens.encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([tokens.END_ID], dtype=encoder.dtype).tobytes()
        doc_ids, lengths, data, n = [], [], [], 0

        def cut() -> pa.RecordBatch:
            nonlocal start, n
            blob = write_segment(doc_ids, lengths, np.frombuffer(b"".join(data), dtype=encoder.dtype))
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())],
                names=["part", "start_in_part", "n_tokens", "segment"],
            )
            start, n = start + n, 0
            for x in (doc_ids, lengths, data):
                x.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = encoder.encode(text.as_py()) + end
                doc_ids.append(doc_id)
                lengths.append(len(got) // encoder.dtype.itemsize)
                data.append(got)
                n += lengths[-1]
                if n >= SEGMENT_TOKENS:
                    yield cut()
        if doc_ids:
            yield cut()

    ship(docs.sparkSession)
    # The hash parts even one id that very many rows share; equal rows need no order.
    dealt = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    dealt = dealt.repartitionByRange(F.col("d").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("d").asc_nulls_first(), F.col("h"))
    return dealt.select("d", "t").mapInArrow(lean(run), schema)


def write(docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents' ids as a table of segments in the shared folder; the table as read back. The table is not
    compressed: a segment's bytes stand in the file as they are."""
    return stage(segments(docs, tokenizer or tokens.default_path(), id_col=id_col, text_col=text_col), "tokens", compression="none")


def read(files: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """A row for each document of a table of segments: where it starts, its length and its checksum."""
    # One row for each part, which are as many as the write had partitions.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(first, F.lit(0)).alias("first"))
    placed = files.join(F.broadcast(parts), "part").select((F.col("first") + F.col("start_in_part")).alias("start"), "segment")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seg = Segment(blob.as_buffer())
                crc = [zlib.crc32(seg.document(k).astype("<u4").tobytes()) for k in range(seg.n_docs)]
                at = seg.starts.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg.doc_ids, pa.int64()), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    names=[id_col, "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(lean(run), f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def export_segments(files: DataFrame, folder: str) -> list[str]:
    """Write the segments as plain files, in order, one at a time, into a folder of this machine."""
    import os

    names = []
    for r in files.orderBy("part", "start_in_part").select("segment").toLocalIterator():
        names.append(os.path.join(folder, f"tokens-{len(names):08d}.dac"))
        with open(names[-1], "wb") as f:
            f.write(r.segment)
    return names


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents")))
