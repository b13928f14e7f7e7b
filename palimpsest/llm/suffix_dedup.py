"""Suffix-array dedup: removes every byte that a repeated string of `length` bytes covers.

A suffix array of all texts would be many times the corpus, so only suffixes that can matter are sorted, and
the sort is induced and external:

1. Anchors. Of any 192 neighbouring positions the one with the least hash of its next 16 bytes is an anchor. The
   anchor of a string of 400 bytes is that of its first 192 positions: equal strings have it at the same
   place, so strings are compared under one anchor only. An anchor stands for its hull, the bytes of all strings
   that have it, and its class, the bytes after it that all of them share.
2. Classes that hold one anchor are unique text. Hulls that occur twice are repeated as a whole. Both are
   counts, combined before the shuffle. What is left are anchors whose class is repeated and whose hull is not.
3. Those are cut into blocks of 32 strings. A block is a tuple: the digest of the bytes that all its strings have,
   the bytes before them and the bytes after them. A task orders the tuples by (digest, bytes after) in
   a priority queue whose runs lie on disk, and takes from neighbours their common-prefix values. From the order
   of the strings that begin at a position, that of those that begin a byte earlier is induced: members of
   a group are dealt by that byte, keeping their order, and the common prefix of new neighbours is the
   least between them. A string is repeated if a neighbour shares it to its end. A block that too many others
   share is cut in halves, which are other blocks of half the strings, again and again down to one string,
   whose repeats are a count; so no task holds more than a bounded group, and none is dropped.
4. The covered bytes of each text are put together and cut out.

Digests are of 128 bits. Cases: null and empty texts have no bytes; texts shorter than the length are kept;
overlapping repeats within one text count; very long texts are taken whole; equal rows are repeats of each
other; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import lean, ship, stage, table
from palimpsest.llm.jaccard import mixed

LENGTH = 400
WINDOW, CONTEXT = 192, 16
BLOCK = 32
#: Members that a class may have to be sorted by one task; a larger one is cut in halves.
HOT = 20_000
#: Tuples that a queue holds in memory, and that one induction takes, besides the last class.
RUN = 100_000
#: Ids of texts up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _digest(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(p)
    return h.digest()


def anchors(data: bytes, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): the strings that start at first..last have this anchor. All starts are in one."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    x = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    for k in (1, 2, 4):  # eight bytes from each position on
        x = x[:-k] | (x[k:] << np.uint64(8 * k))
    h = mixed(x[:-8] * _K1 + x[8:] * _K2)
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equals
    width = 1
    while 2 * width <= window:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if window > width:
        key = np.minimum(key[: len(key) - (window - width)], key[window - width :])
    at = (key[: n - length + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the anchor of each start
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], first, np.append(first[1:], len(at)) - 1


class DiskQueue:
    """A priority queue of tuples that keeps at most `run` of them in memory: sorted runs go to disk, and are
    merged as they are read back. The files are gone when the queue is."""

    def __init__(self, run: int = RUN):
        self.run, self.held, self.files = run, [], []

    def push(self, item: tuple) -> None:
        self.held.append(item)
        if len(self.held) >= self.run:
            self.held.sort()
            f = tempfile.TemporaryFile(prefix="palimpsest-run-")  # scratch of this task alone
            for a in range(0, len(self.held), 1000):
                pickle.dump(self.held[a : a + 1000], f, protocol=5)
            self.files.append(f)
            self.held = []

    @staticmethod
    def _read(f) -> Iterator[tuple]:
        f.seek(0)
        size = os.fstat(f.fileno()).st_size
        while f.tell() < size:
            yield from pickle.load(f)

    def __iter__(self) -> Iterator[tuple]:
        self.held.sort()
        yield from heapq.merge(*map(self._read, self.files), self.held)
        for f in self.files:
            f.close()
        self.files, self.held = [], []


def _padded(strings: list[bytes], width: int) -> np.ndarray:
    """[row, place] bytes and one, 0 where a string has ended."""
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), width).astype(np.int16) + 1
    flat[np.arange(width) >= np.array([len(s) for s in strings])[:, None]] = 0
    return flat


def induce(digests: list[bytes], befores: list[bytes], afters: list[bytes], width: int) -> np.ndarray:
    """Of tuples in (digest, after) order: [row, k], whether the string that starts k bytes before the shared bytes is
    another row's too. A row has at most width - 1 bytes before and after; string k takes k of the first and
    width - 1 - k of the second."""
    m, span = len(digests), width - 1
    out = np.zeros((m, width), dtype=bool)
    if m < 2:
        return out
    after, before = _padded(afters, span), _padded([b[::-1] for b in befores], span)
    ended = np.array([len(a) for a in afters])
    same = (after[1:] == after[:-1]) & (after[1:] > 0)
    common = np.where(same.all(axis=1), span, same.argmin(axis=1)) if span else np.zeros(m - 1, np.int64)
    new = np.array([x != y for x, y in zip(digests[1:], digests[:-1], strict=True)])
    group = np.concatenate(([0], np.cumsum(new)))
    rows, common = np.arange(m), np.concatenate(([0], common))  # common[i]: with the one before it
    for k in range(width):
        need = span - k
        if k:
            # Those that go a byte further back, dealt by that byte within their group, in the order they have.
            byte = before[rows, k - 1]
            code = group * 257 + byte
            order = np.argsort(code, kind="stable")
            order = order[byte[order] > 0]
            if len(order) < 2:
                break
            # What neighbours-to-be have in common is the least between them: of a sparse table of ranges.
            lo, hi = order[:-1] + 1, order[1:]
            linked = code[order][1:] == code[order][:-1]
            least = np.zeros(len(order), dtype=np.int64)
            adjacent = linked & (hi == lo)
            least[1:][adjacent] = common[hi[adjacent]]
            far = np.flatnonzero(linked & (hi > lo))
            if len(far):
                level, tables = 1, [common]
                while 2 * level <= int((hi[far] - lo[far] + 1).max()):
                    t = tables[-1]
                    tables.append(np.minimum(t, np.concatenate((t[level:], np.zeros(level, t.dtype)))))
                    level *= 2
                size = np.floor(np.log2(hi[far] - lo[far] + 1)).astype(np.int64)
                stacked = np.stack(tables)
                least[1:][far] = np.minimum(stacked[size, lo[far]], stacked[size, hi[far] - (1 << size) + 1])
            rows, common, code = rows[order], least, code[order]
            group = np.concatenate(([0], np.cumsum(code[1:] != code[:-1])))
        # Equal up to their ends, or beyond them, is not enough: both must have all of the string.
        pair = (group[1:] == group[:-1]) & (common[1:] >= need)
        hit = np.concatenate(([False], pair)) | np.concatenate((pair, [False]))
        hit &= ended[rows] >= need
        out[rows[hit], k] = True
    return out


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """h1, h2 (of the text), at, first, last, class, d1, d2 (digest of the hull)."""
    names = ["h1", "h2", "at", "first", "last", "class", "d1", "d2"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part, cols = batch.slice(a, 500), []
                for h1, h2, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if not data or len(data) < length:
                        continue
                    at, first, last = anchors(data, length)
                    view, shared = memoryview(data), length - WINDOW + 1
                    kinds = b"".join([hashlib.blake2b(view[i : i + shared], digest_size=8).digest() for i in at.tolist()])
                    hulls = b"".join([hashlib.blake2b(view[x : y + length], digest_size=16).digest() for x, y in zip(first.tolist(), last.tolist(), strict=True)])
                    own = np.frombuffer(hulls, dtype=np.int64).reshape(-1, 2)
                    cols.append(np.stack((np.full(len(at), h1), np.full(len(at), h2), at, first, last, np.frombuffer(kinds, dtype=np.int64), own[:, 0], own[:, 1])))
                if cols:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(cols, axis=1)], names=names)

    return docs.select("h1", "h2", "data").mapInArrow(lean(run), ", ".join(f"{n} long" for n in names))


def _of_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose (h1, h2) is among ids: sent to them while they are few, so that texts of others stay."""
    ids = ids.select("h1", "h2").distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, ["h1", "h2"], "left_semi")


_TUPLE = "width int, digest binary, before binary, after binary, h1 long, h2 long, base long, lo int, hi int"


def _blocks(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """Tuples of the blocks of open anchors: width, digest, before, after, h1, h2, base, lo, hi (strings lo..hi are the
    anchor's own)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h1, h2, data, wanted = (batch.column(c)[i].as_py() for c in range(4))
                rows = []
                for w in wanted:
                    for j in range((w["at"] - w["last"]) // BLOCK, (w["at"] - w["first"]) // BLOCK + 1):
                        base = w["at"] - BLOCK * j
                        end = base + length - BLOCK + 1
                        if base < 0 or end > len(data):  # then no string of this block lies in the text
                            continue
                        lo, hi = max(0, base - w["last"]), min(BLOCK - 1, base - w["first"])
                        if lo > hi:
                            continue
                        rows.append((BLOCK, _digest(j.to_bytes(2, "little"), data[base:end]), data[max(0, base - BLOCK + 1) : base], data[end : end + BLOCK - 1], h1, h2, base, lo, hi))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=_NAMES)

    listed = open_.groupBy("h1", "h2").agg(F.collect_set(F.struct("at", "first", "last")).alias("wanted"))
    # Copies of a text are one witness: their tuples are equal, and are dropped by distinct() before they meet.
    return _of_texts(docs, open_).join(listed, ["h1", "h2"]).select("h1", "h2", "data", "wanted").mapInArrow(lean(run), _TUPLE).distinct()


_NAMES = [x.split()[0] for x in _TUPLE.split(", ")]
_ARROW = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _halves(rows: DataFrame) -> DataFrame:
    """Each block as two of half its strings, which share more bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for width, digest, before, after, h1, h2, base, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = width // 2
                if lo < w and len(after) >= w:
                    out.append((w, _digest(digest, b"a", after[:w]), before[max(0, len(before) - w + 1) :], after[w:], h1, h2, base, lo, min(hi, w - 1)))
                if hi >= w and len(before) >= w:
                    out.append((w, _digest(digest, b"b", before[-w:]), before[:-w], after[: w - 1], h1, h2, base - w, max(0, lo - w), hi - w))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW, strict=True)], names=_NAMES)

    return rows.select(*_NAMES).mapInArrow(lean(run), _TUPLE)


def _repeated(rows: DataFrame) -> DataFrame:
    """(h1, h2, first, last) of the repeated strings of the tuples' own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = DiskQueue(RUN)
        for batch in batches:
            for width, digest, before, after, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                queue.push((width, digest, after, before, *own))
        held: list[tuple] = []

        def solve() -> Iterator[pa.RecordBatch]:
            hit = induce([t[1] for t in held], [t[3] for t in held], [t[2] for t in held], held[0][0])
            out = []
            for i in np.flatnonzero(hit.any(axis=1)).tolist():
                _, _, _, _, h1, h2, base, lo, hi = held[i]
                ks = [k for k in range(lo, hi + 1) if hit[i, k]]
                for j, k in enumerate(ks):  # runs of neighbouring strings
                    if not j or ks[j - 1] != k - 1:
                        out.append([h1, h2, base - k, base - k])
                    else:
                        out[-1][2] = base - k
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["h1", "h2", "first", "last"])

        for item in queue:
            if held and (item[0] != held[0][0] or len(held) >= RUN and item[1] != held[-1][1]):
                yield from solve()
                held = []
            held.append(item)
        if held:
            yield from solve()

    return rows.select(*_NAMES).repartition("digest").mapInArrow(lean(run), "h1 long, h2 long, first long, last long")


def covered(docs: DataFrame, length: int) -> DataFrame:
    """(h1, h2, first, last): repeated strings start at first..last of these texts. docs: h1, h2, data."""
    rows = stage(_anchor_rows(docs, length), "anchors")
    # Both counts are combined where the rows lie before they are dealt out, and are written before they are joined: a class
    # or hull that a third of all anchors share is one row of a count, and a join that can be split by size.
    classes = rows.groupBy("class").agg(F.count("*").alias("n"), F.min("d1").alias("lo"), F.max("d1").alias("hi"))
    classes = stage(classes.filter("n > 1").select("class", (F.col("lo") != F.col("hi")).alias("several")), "classes")
    met = stage(rows.join(classes, "class").withColumn("own", F.xxhash64("h1", "h2", "at")), "repeated")
    hulls = stage(met.groupBy("class", "d1", "d2").agg(F.count("*").alias("n"), F.min("own").alias("witness")), "hulls")
    # Open anchors, and one of each repeated hull of the same classes, with which they may share strings.
    opened = F.col("several") & (F.col("own") == F.col("witness"))
    met = met.join(hulls, ["class", "d1", "d2"]).select("h1", "h2", "at", "first", "last", (F.col("n") > 1).alias("whole"), opened.alias("open"))
    met = stage(met, "met")
    parts = [met.filter("whole").select("h1", "h2", "first", "last").distinct()]
    blocks = stage(_blocks(docs, met.filter("open").select("h1", "h2", "at", "first", "last"), length), "blocks")
    width = BLOCK
    while True:
        counts = stage(blocks.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
        joined = blocks.join(counts, "digest")
        if width == 1:
            # One string, no bytes beside the shared ones: all that share a digest are repeats.
            parts.append(joined.select("h1", "h2", F.col("base").alias("first"), F.col("base").alias("last")))
            break
        parts.append(_repeated(joined.filter(F.col("n") <= HOT)))
        hot = joined.filter(F.col("n") > HOT)
        if not hot.limit(1).count():
            break
        blocks, width = stage(_halves(hot), "halves"), width // 2
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return stage(out.distinct(), "covered")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256 for each document."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    data = docs.select(F.col(id_col).alias("__id"), text.cast("binary").alias("data")).withColumns({"h1": F.xxhash64("data"), "h2": F.xxhash64(F.lit(7), F.col("data"))})
    found = covered(data.select("h1", "h2", "data").filter(F.octet_length("data") >= length), length)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for a, b in sorted((r["first"], r["last"] + length) for r in runs):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(data), len(data) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    ids = found.select("h1", "h2").distinct()
    few = ids.count() <= BROADCAST_ROWS
    ids = F.broadcast(ids) if few else ids
    # Texts without repeats go no further than this.
    clean = data.join(ids, ["h1", "h2"], "left_anti").select(
        F.col("__id").alias(id_col), F.octet_length("data").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("data").alias("kept"), F.sha2("data", 256).alias("kept_sha256")
    )
    runs = stage(found.groupBy("h1", "h2").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "runs")
    cut = data.join(ids, ["h1", "h2"], "left_semi").join(runs, ["h1", "h2"]).select("__id", "data", "runs")
    return clean.union(cut.mapInArrow(lean(run), f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the text that is left, in which a character that a removal cuts through is U+FFFD."""
    found = dedup(table(spark, sf_dir, "documents"))
    return found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")
