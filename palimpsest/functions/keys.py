"""Scalar expressions: fixed-width keys, kinds, flags, block arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT_SNAP = 4294967295
LIVE, DELETED, WHITEOUT = 0, 1, 2
BLOCK = 4096
MODE_TYPE, MODE_DIR, MODE_FILE, MODE_LINK = 0o170000, 0o040000, 0o100000, 0o120000
READONLY = 1
NAME_MAX, KEY_MAX, VALUE_MAX = 19, 28, 96
FRAME_MAGIC, FRAME_OP, FRAME_COMMIT = b"PLOG", 1, 2


def be(value: Column, width: int) -> Column:
    """A non-negative integer as big-endian bytes, whose unsigned byte order is the numbers' order."""
    return F.unhex(F.lpad(F.hex(value), 2 * width, "0"))


def from_be(data: Column) -> Column:
    return F.conv(F.hex(data), 16, 10).cast("long")


def sortable(logical: Column, snap: Column) -> Column:
    """Logical key, then the snapshot id: the order of all listings."""
    return F.concat(logical, be(snap, 4))


def in_byte_range(sort_key: Column, start: Column, end: Column) -> Column:
    """Half-open, on sortable bytes; bounds are logical keys, with snapshot id 0."""
    zero = F.unhex(F.lit("00000000"))
    return (sort_key >= F.concat(start, zero)) & (sort_key < F.concat(end, zero))


def is_type(mode: Column, kind: int) -> Column:
    return mode.bitwiseAND(F.lit(MODE_TYPE)) == kind


def has_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(flag)) != 0


def align_down(offset: Column) -> Column:
    return offset - offset % BLOCK


def blocks_of(size: Column) -> Column:
    return F.floor((size + (BLOCK - 1)) / BLOCK).cast("long")


def name_problem(name: Column) -> Column:
    """Null if the name is valid, else what is wrong with it. Length is in bytes."""
    return (
        F.when(F.coalesce(F.octet_length(name), F.lit(0)) == 0, "empty")
        .when(name.isin(".", ".."), "reserved")
        .when(name.contains("/") | name.contains("\0"), "character")
        .when(F.octet_length(name) > NAME_MAX, "too long")
    )


def epoch_seconds(time: Column) -> Column:
    """Whole seconds since 1970 of a time without a zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), time.cast("timestamp_ntz"))


def encoded_record(key: Column, value: Column) -> Column:
    """A log record's bytes: the key's length in one byte, the key, the value. The kind stands in the frame."""
    return F.concat(be(F.octet_length(key), 1), key, F.coalesce(value, F.lit(b"")))


def decoded_record(data: Column) -> Column:
    """Struct of key and value; null where the bytes are too few."""
    n = F.conv(F.hex(F.substring(data, F.lit(1), F.lit(1))), 16, 10).cast("int")
    parts = F.struct(F.substring(data, F.lit(2), n).alias("key"), F.substring(data, n + 2, F.octet_length(data)).alias("value"))
    return F.when((F.octet_length(data) >= 1) & (F.octet_length(data) >= n + 1), parts)


def frame_bytes(seq: Column, frame_kind: Column, op_kind: Column, data: Column) -> Column:
    return F.concat(F.lit(FRAME_MAGIC), be(seq, 8), be(frame_kind, 1), be(op_kind, 1), be(F.octet_length(data), 2), data)


def frame_valid(checksum: Column, seq: Column, expected: Column, frame_kind: Column, op_kind: Column, data: Column) -> Column:
    """A frame holds if it has its place's seq, a known kind and its checksum."""
    return (seq == expected) & frame_kind.isin(FRAME_OP, FRAME_COMMIT) & (checksum == F.crc32(frame_bytes(seq, frame_kind, op_kind, data)))
