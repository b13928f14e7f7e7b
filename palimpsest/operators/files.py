"""Sparse byte ranges over block-aligned extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.keys import BLOCK, align_down


def extents_in_range(extents: DataFrame, ino: int, a: int, b: int) -> DataFrame:
    """Visible extents keyed in [a, b)."""
    return extents.filter((F.col("ino") == ino) & (F.col("off") >= a) & (F.col("off") < b))


def read_segments(sizes: DataFrame, extents: DataFrame, reads: DataFrame) -> DataFrame:
    """The parts of reads (ino, start, count): block by block, data or hole.

    A read is clipped to the file's size; a missing file or a start beyond its end has no parts. An extent starts
    at a block's start, so blocks meet extents by equality, not by a comparison of ranges. Returned: ino, start,
    at (file offset), n (bytes), data_block (null: zeros), skip (bytes of the block before `at`).
    """
    end = F.least(F.col("start") + F.col("count"), F.col("size"))
    clipped = reads.join(sizes, "ino").withColumn("end", end).filter("start < end")
    blocks = F.sequence(align_down(F.col("start")), align_down(F.col("end") - 1), F.lit(BLOCK).cast("long"))
    parts = clipped.select("ino", "start", "end", F.explode(blocks).alias("off"))
    met = parts.join(extents.select("ino", "off", "data_block", "len"), ["ino", "off"], "left")
    at = F.greatest("off", "start")
    stop = F.least(F.col("off") + BLOCK, F.col("end"))
    met = met.withColumn("at", at).withColumn("stop", stop).withColumn("data_end", F.col("off") + F.coalesce("len", F.lit(0)))
    data_n = F.greatest(F.lit(0).cast("long"), F.least("stop", "data_end") - F.col("at"))
    met = met.withColumn("data_n", data_n).withColumn("hole_n", F.col("stop") - F.col("at") - data_n)
    no_block = F.lit(None).cast("long")
    data = F.struct(F.col("at").alias("at"), F.col("data_n").alias("n"), F.col("data_block").cast("long").alias("data_block"), (F.col("at") - F.col("off")).alias("skip"))
    hole = F.struct((F.col("at") + F.col("data_n")).alias("at"), F.col("hole_n").alias("n"), no_block.alias("data_block"), F.lit(0).cast("long").alias("skip"))
    return met.select("ino", "start", F.explode(F.array(data, hole)).alias("p")).select("ino", "start", "p.*").filter("n > 0")


def read_bytes(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """ino, start, data of each read: its parts in order, holes as zeros."""
    met = segments.join(blocks.select(F.col("block_nr").alias("data_block"), "payload"), "data_block", "left")
    own = F.substring("payload", F.col("skip").cast("int") + 1, F.col("n").cast("int"))
    padded = F.unhex(F.concat(F.hex(F.coalesce(own, F.lit(b""))), F.repeat(F.lit("00"), (F.col("n") - F.coalesce(F.octet_length(own), F.lit(0))).cast("int"))))
    parts = F.array_sort(F.collect_list(F.struct("at", padded.alias("d"))))
    # A read's parts are as many as its blocks.
    return met.groupBy("ino", "start").agg(F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["d"])), "")).alias("data"))


def write_chunks(writes: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Writes (ino, start, data) cut at block bounds: ino, off, in_block, piece and the merged block, over what `old`
    (ino, off, payload) holds there: bytes before and after the piece stay, a gap is zeros."""
    n = F.octet_length("data")
    blocks = F.sequence(align_down(F.col("start")), align_down(F.col("start") + n - 1), F.lit(BLOCK).cast("long"))
    cut = writes.filter(n > 0).select("ino", "start", "data", F.explode(blocks).alias("off"))
    a, b = F.greatest("off", "start"), F.least(F.col("off") + BLOCK, F.col("start") + n)
    piece = F.substring("data", (a - F.col("start")).cast("int") + 1, (b - a).cast("int"))
    cut = cut.select("ino", "off", (a - F.col("off")).alias("in_block"), piece.alias("piece"))
    if old is None:
        return cut.withColumn("payload", _merge(F.lit(b""), F.col("in_block"), F.col("piece")))
    met = cut.join(old.select("ino", "off", F.col("payload").alias("__old")), ["ino", "off"], "left")
    return met.withColumn("payload", _merge(F.coalesce("__old", F.lit(b"")), F.col("in_block"), F.col("piece"))).drop("__old")


def _merge(old: Column, at: Column, piece: Column) -> Column:
    head = F.rpad(F.hex(F.substring(old, F.lit(1), at.cast("int"))), (at * 2).cast("int"), "0")
    tail = F.hex(F.substring(old, (at + F.octet_length(piece)).cast("int") + 1, F.lit(BLOCK)))
    return F.unhex(F.concat(head, F.hex(piece), tail))


def file_size(chunks: DataFrame) -> DataFrame:
    """(ino, size): the furthest end of what was written."""
    return chunks.groupBy("ino").agg(F.max(F.col("off") + F.col("len")).cast("long").alias("size"))


def truncate(extents: DataFrame, targets: DataFrame, snap: int) -> DataFrame:
    """The delta of cutting files (ino, size): ino, off, len, snap_id, kind, frees.

    Extents from size on go (Deleted where the own snapshot holds them, else Whiteout; a block is freed only if the
    own snapshot holds it, as ancestors may still read it); one that the cut goes through is shortened."""
    met = extents.join(targets.select("ino", F.col("size").alias("cut")), "ino").filter(F.col("off") + F.col("len") > F.col("cut"))
    gone, own = F.col("off") >= F.col("cut"), F.col("snap_id") == int(snap)
    kind = F.when(gone, F.when(own, 1).otherwise(2)).otherwise(0)
    return met.select("ino", "off", F.when(gone, F.lit(0)).otherwise(F.col("cut") - F.col("off")).cast("long").alias("new_len"), F.lit(int(snap)).cast("long").alias("snap_id"), kind.alias("kind"), (gone & own).alias("frees"))
