"""N-gram Jaccard join: all documents whose 5-word shingle sets have a similarity of 0.75 or more, as components.

A document's set is a sorted array of 64-bit shingle hashes. Equal sets are one node. Two sets that are similar
enough have a shingle in common among the first quarter (and one) of each in any fixed order; with
frequent shingles last in that order, the most frequent at its end, few other sets share one. Sets that share one meet in a tile:

1. Stars: in each tile the member of the smallest hash is drawn, under one of several hashes, and a set is
   compared with the one that was drawn most often in its tiles: one pair for each set and hash. Later hashes
   are for sets that are not yet in one component with their star.
2. What is left: tiles whose members are by then in more than one component. They are dealt into size bands (a set
   of fewer than 3/4 of the other's shingles can't be similar, so a set meets its own band and the two beside
   it) and, where a band is large, into blocks. Members of the tile's largest component stay at home in their block;
   only the others visit. A visitor sends its best few pairs with sets of other components. Where it had more, its
   tile is taken up again with the components as they are by then, and each visitor may send more, until no visitor
   has any pair left that was not compared.

Tiles of the same members are one tile. A pair is compared by its bitmaps first: a set's bitmap has the parity of
its shingles for each of four to eight times as many hashed places as it has shingles, and folds to half its width by an
exclusive or of its halves; where tiles are taken up first it is folded to one or two places a shingle. The bits in which two bitmaps of one
width differ are no more than the shingles the sets differ in, which bounds the overlap from above. Pairs that pass have
their sorted arrays intersected. So no link between different components is missed, no pair within one is made for
nothing, and what a tile sends follows its members, not their pairs.

Cases: null, empty and word-less texts have empty sets and are linked with nothing; a text of fewer than five
words is one shingle; very long texts are taken whole; repeated rows are in one component; a null id counts
only if the whole component has no other; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import free, lean, ship, stage, swept, table
from palimpsest.llm.components import components

WORDS = 5
#: Similarity in percent.
PERCENT = 75
#: Bits of a bitmap: the power of two that is not below four times the set's size, within these bounds.
BITS = (256, 1 << 17)
#: A shingle counts as frequent if so many different sets of some lot of neighbouring texts have it, and twice as many of
#: such lots together; so many make the list; which shingles are on it changes only the work, not the result.
FREQUENT = 2
FREQUENT_KEPT = 1 << 19
#: Shingles of a lot.
LOT = 2_000_000
#: Keys of a bucket, about.
BUCKET_KEYS = 1 << 19
#: Rounds of stars, each of so many hashes. Sets that more rounds would link are found in the tiles that stay open.
ROUNDS = ((0, 1),)
#: Sets at home in a block of a large band.
BLOCK = 4096
#: Pairs that a visitor sends from a block at first, and by what that grows when its tile is taken up again.
BEST, MORE = 2, 32
#: Pairs, and words of bitmaps, that are compared at a time.
AT_ONCE = 1 << 19
#: Bytes of fixed-width ids up to which a table is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        base, inverse = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        base[0] = inverse[0] = 1
        _powers, _inverses = np.cumprod(base), np.cumprod(inverse)
    return _powers, _inverses


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles."""
    flat = b" ".join((text or b"").lower().split())  # bytes: A-Z alone are lowered; split at space, \t-\r
    if not flat:
        return np.zeros(0, dtype=np.uint64)
    b = np.frombuffer(flat, dtype=np.uint8).astype(np.uint64)
    powers, inverses = _tables(len(b) + 1)
    # A stretch's hash is the difference of two running sums, shifted back to the start: the same wherever it stands.
    run = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((b + np.uint64(1)) * powers[: len(b)])))
    spaces = np.flatnonzero(b == 32)
    starts, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(b)]))
    m = max(1, len(starts) - k + 1)
    starts, ends = starts[:m], ends[-m:]
    return np.unique(mixed((run[ends] - run[starts]) * inverses[starts] + (ends - starts).astype(np.uint64)))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    width = min(BITS[1], max(BITS[0], 1 << max(0, 4 * len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def sig_words(n: int) -> int:
    """64-bit words of a bitmap as tiles compare it: the power of two of bits that is not below the set's size."""
    return min(BITS[1], max(BITS[0], 1 << max(0, n - 1).bit_length())) // 64


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps, one or one a row, at a smaller width."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Of sorted arrays of distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(b) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def may_link(n: int, m, differ, percent: int = PERCENT):
    """Whether sets of n and m hashes whose bitmaps differ in so many bits may be linked: the overlap is at most
    (n + m - differ) / 2. m and differ may be arrays."""
    over = (n + m - differ) // 2
    return 100 * over >= percent * (n + m - over)


def _sizes_fit(n: int, m, percent: int):
    return (100 * n >= percent * m) & (100 * m >= percent * n)


class _Bits:
    """Bitmaps of several widths, as a matrix a width, and those matrices folded."""

    def __init__(self, bits: list[bytes]):
        self.width = np.array([len(x) // 8 for x in bits], dtype=np.int64)
        self.place = np.zeros(len(bits), dtype=np.int64)
        self.at: dict[tuple[int, int], np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.place[own] = np.arange(len(own))
            self.at[w, w] = np.frombuffer(b"".join([bits[i] for i in own]), dtype=np.uint64).reshape(len(own), w)

    def _of(self, width: int, words: int) -> np.ndarray:
        if (width, words) not in self.at:
            self.at[width, words] = folded(self.at[width, width], words)
        return self.at[width, words]

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which i and j differ, at the width of the narrower one."""
        out = np.zeros(len(i), dtype=np.int64)
        both = self.width[i] * (1 << 32) + self.width[j]
        for code in np.unique(both).tolist():
            a, b = code >> 32, code & 0xFFFFFFFF
            words = min(a, b)
            left, right, own = self._of(a, words), self._of(b, words), np.flatnonzero(both == code)
            for lot in range(0, len(own), step := max(1, AT_ONCE // words)):
                part = own[lot : lot + step]
                out[part] = np.bitwise_count(left[self.place[i[part]]] ^ right[self.place[j[part]]]).sum(axis=1, dtype=np.int64)
        return out


def best_pairs(group, visits, major, node, label, n, bits: list[bytes], percent: int, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, more) of rows in the order (group, visits): each visitor i with the `best` sets j at home in its group that
    are of another component and may be linked with it, and whether it had more. Of two sets that visit each other
    the one of the smaller id does so."""
    ids = np.flatnonzero(visits)
    none = np.zeros(0, np.int64)
    if not len(ids) or len(ids) == len(visits):
        return none, none, none.astype(bool)
    first = np.searchsorted(group, group[ids])
    homes = np.cumsum(~visits)
    count = homes[ids] - np.where(first > 0, homes[first - 1], 0)
    sets, out = _Bits(bits), []
    ends = np.cumsum(count)
    a = 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, side="right")))
        i = np.repeat(ids[a:b], count[a:b])
        j = np.arange(len(i)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b]) + np.repeat(first[a:b], count[a:b])
        ok = (label[i] != label[j]) & (major[j] | (node[i] < node[j])) & _sizes_fit(n[i], n[j], percent)
        i, j = i[ok], j[ok]
        differ = sets.differ(i, j)
        ok = may_link(n[i], n[j], differ, percent)
        i, j, differ = i[ok], j[ok], differ[ok]
        order = np.lexsort((node[j], differ / (n[i] + n[j]), i))
        i, j = i[order], j[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(i)), bool), i[1:] != i[:-1])))
        sizes = np.diff(np.append(new, len(i)))
        rank = np.arange(len(i)) - np.repeat(new, sizes)
        more, kept = np.repeat(sizes > best, sizes), rank < best
        out.append((i[kept], j[kept], more[kept]))
        a = b
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that many sets have, at most FREQUENT_KEPT, sorted, and their places by how many do."""

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
        many = counts >= FREQUENT
        return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], names=["h", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size, seen = [], 0, set()
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                h = shingles(t, k)
                digest = hashlib.blake2b(h.tobytes(), digest_size=8).digest()
                if len(h) and digest not in seen:  # a set counts once in a lot
                    seen.add(digest)
                    sets.append(h)
                    size += len(h)
            if size >= LOT:
                yield counted(sets)
                sets, size, seen = [], 0, set()
        yield counted(sets)

    found = docs.mapInArrow(lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= 2 * FREQUENT)
    listed = found.orderBy(F.desc("n"), "h").limit(FREQUENT_KEPT).toArrow()
    h, n = (np.array(listed.column(c).to_numpy(), dtype=np.int64) for c in ("h", "n"))
    order = np.argsort(h.view(np.uint64))
    rank = np.zeros(len(h), dtype=np.int32)
    rank[np.lexsort((h, n))] = np.arange(len(h))
    return h.view(np.uint64)[order], rank[order]


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, frequent) -> DataFrame:
    """id, n, node, check, bits, sig (the bits, folded), keys (the first hashes in the order, 8 bytes each), text_hash."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, rank = frequent.value
        for batch in batches:
            rows = []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                h = shingles(t, k)
                n = len(h)
                digest = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                first = n - -(-percent * n // 100) + 1 if n else 0
                if n and len(late):
                    at = np.searchsorted(late, h)
                    at[at == len(late)] = 0
                    is_late = late[at] == h
                    h_first = h[~is_late][:first]
                    if len(h_first) < first:  # of the frequent ones the rarest
                        h_first = np.concatenate((h_first, h[is_late][np.argsort(rank[at[is_late]])]))[:first]
                else:
                    h_first = h[:first]
                bits = bitmap(h)
                rows.append((n, int.from_bytes(digest[:8], "little", signed=True), digest[8:], bits.tobytes(), folded(bits, sig_words(n)).tobytes(), h_first.tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=[id_col, "text_hash", "n", "node", "check", "bits", "sig", "keys"])

    source = docs.select(id_col, F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__hash"))
    return source.mapInArrow(lean(run), f"`{id_col}` {kind}, text_hash long, n long, node long, check binary, bits binary, sig binary, keys binary")


def _tiles(sets: DataFrame, keys: int) -> DataFrame:
    """tile, node, weight, star0, star1, ...: the nodes that meet in some key. A tile stands for all keys of the
    same nodes, weight says for how many."""
    draws = [d for drawn in ROUNDS for d in drawn]
    buckets = max(keys // BUCKET_KEYS, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    names = ["tile", "node", "weight", *[f"star{d}" for d in draws]]

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(1).to_pylist()]
            hashes = np.concatenate([*parts, np.zeros(0, np.uint64)])
            nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(p) for p in parts]).astype(np.int64)
            if not len(hashes):
                continue
            bucket = (mixed(hashes) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((nodes, hashes, bucket))
            hashes, nodes, bucket = hashes[order], nodes[order], bucket[order]
            new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (nodes[1:] != nodes[:-1])))  # copies in this batch
            hashes, nodes, bucket = hashes[new], nodes[new], bucket[new]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            data = [hashes[a:b].tobytes() + nodes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(data, pa.binary())], names=["bucket", "data"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got.setdefault(b, []).append(d)
        while got:
            halves = [np.frombuffer(d, dtype=np.uint64).reshape(2, -1) for d in got.popitem()[1]]
            both = np.concatenate(halves, axis=1)
            order = np.lexsort((both[1], both[0]))
            hashes, nodes = both[0][order], both[1][order]
            new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (nodes[1:] != nodes[:-1])))
            hashes, nodes = hashes[new], nodes[new]
            first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            sizes = np.diff(np.append(first, len(hashes)))
            many = np.repeat(sizes > 1, sizes)
            hashes, nodes, sizes = hashes[many], nodes[many], sizes[sizes > 1]
            if not len(hashes):
                continue
            first, stars = np.cumsum(sizes) - sizes, []
            # The sum of its members' hashes names a tile. Should two tiles ever have one sum, they are joined.
            tile = np.add.reduceat(mixed(nodes), first)
            _, one, counts = np.unique(tile, return_index=True, return_counts=True)
            kept = np.zeros(len(first), dtype=bool)
            kept[one] = True
            weight = np.zeros(len(first), dtype=np.int64)
            weight[one] = counts
            tile, weight, nodes, sizes = np.repeat(tile[kept], sizes[kept]), np.repeat(weight[kept], sizes[kept]), nodes[np.repeat(kept, sizes)], sizes[kept]
            first = np.cumsum(sizes) - sizes
            for d in draws:
                drawn = mixed(nodes + np.uint64((d + 1) * _BASE % (1 << 64)))
                least = np.repeat(np.minimum.reduceat(drawn, first), sizes)
                stars.append(np.repeat(nodes[drawn == least], sizes))  # one node has a hash: mixed() is one to one
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (tile, nodes, weight, *stars)], names=names)

    dealt = sets.select("node", "keys").mapInArrow(lean(deal), "bucket long, data binary")
    met = dealt.repartition(buckets, "bucket").mapInArrow(lean(meet), ", ".join(f"{c} long" for c in names))
    return met.groupBy("tile", "node").agg(F.sum("weight").alias("weight"), *[F.min(c).alias(c) for c in names[3:]])


def _stars(tiles: DataFrame, drawn: tuple[int, ...], labels: DataFrame | None) -> DataFrame:
    """(a, b): each node and the star that it has in most of its tiles, if they are not of one component yet."""
    out = None
    for d in drawn:
        counted = tiles.select("node", "weight", F.col(f"star{d}").alias("star")).filter("node <> star").groupBy("node", "star").agg(F.sum("weight").alias("count"))
        best = counted.groupBy("node").agg(F.max_by("star", F.struct("count", "star")).alias("star"))
        out = best if out is None else out.union(best)
    if labels is not None:
        of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
        out = out.join(of("node"), "node", "left").join(of("star"), "star", "left")
        out = out.filter(~F.coalesce("label_node", "node").eqNullSafe(F.coalesce("label_star", "star")))
    return out.select(F.least("node", "star").alias("a"), F.greatest("node", "star").alias("b")).distinct()


def _small(df: DataFrame) -> DataFrame:
    """df, of long ids alone, for a broadcast if its bytes allow it."""
    return F.broadcast(df) if 8 * len(df.columns) * df.count() <= BROADCAST_BYTES else df


def _with_both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """a, b, column_a, column_b. Pairs are ids alone: they go to where the column is, so that for each pair only the
    column of one travels."""
    to = lambda x, with_: with_.join(of.select(F.col("node").alias(x), F.col(column).alias(f"{column}_{x}")), x)
    others = to("b", _small(pairs)).hint("merge")
    return others.join(to("a", _small(pairs.select("a").distinct())), "a").select("a", "b", f"{column}_a", f"{column}_b")


def _near(pairs: DataFrame, nodes: DataFrame, percent: int, bitmaps: str) -> DataFrame:
    """Of pairs (a, b), a written table, those that size and these bitmaps let be linked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = (np.frombuffer(s["bits"], np.uint64) for s in (a, b))
                words = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
                keep.append(bool(_sizes_fit(a["n"], b["n"], percent) and may_link(a["n"], b["n"], differ, percent)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_both(pairs, nodes.select("node", F.struct("n", F.col(bitmaps).alias("bits")).alias("set")), "set").mapInArrow(lean(run), "a long, b long")


def _arrays(docs: DataFrame, needed: DataFrame, text_col: str, k: int) -> DataFrame:
    """node, hashes of the needed nodes, from their texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, k) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            nodes = [int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=16).digest()[:8], "little", signed=True) for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "hashes"])

    side = _small(needed.select("text_hash"))
    texts = docs.select(F.col(text_col).alias("t")).withColumn("text_hash", F.xxhash64("t")).join(side, "text_hash", "left_semi")
    # Copies of a text are equal rows: one of each partition goes on, and one of all stays.
    return texts.select("t").mapInArrow(lean(run), "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, text_col: str, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b), a written table, those whose arrays overlap enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    arrays = stage(_arrays(docs, nodes.join(wanted, "node", "left_semi"), text_col, k), "arrays")
    return _with_both(pairs, arrays, "hashes").mapInArrow(lean(run), "a long, b long")


def _open_pairs(tiles: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int, best: int, bitmaps: str = "sig") -> DataFrame:
    """(a, b, tile, more): pairs of different components that share a tile and may be linked by these bitmaps, the
    best ones of each visitor; `more` where it had others."""
    # A little wider than the sizes that may be linked, so that rounding can't part two of them by two bands.
    wide = max(log(100 / percent) * (1 + 1e-6), 1e-6)
    base = nodes.select("node", F.floor(F.log(F.col("n").cast("double")) / wide).cast("long").alias("band")).join(labels, "node", "left")
    members = stage(tiles.select("tile", "node").join(base.withColumn("label", F.coalesce("label", "node")), "node"), "members")
    counts = stage(members.groupBy("tile", "label", "band").agg(F.count("*").alias("c")), "counts")
    major = F.max_by("label", F.struct("c", "label")).alias("major")
    mixed_ = counts.groupBy("tile").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), major).filter("lo <> hi").select("tile", "major")
    bands = counts.groupBy("tile", F.col("band").alias("home")).agg(F.sum("c").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    open_ = stage(members.join(mixed_, "tile"), "mixed")
    visitors = open_.filter("label <> major").withColumn("home", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    visitors = visitors.join(bands, ["tile", "home"]).filter("lo <> label or hi <> label")
    blocks = lambda size: F.ceil(F.col(size) / BLOCK).cast("int")
    visitors = stage(visitors.select("tile", "home", "node", "label", F.explode(F.sequence(F.lit(0), blocks("size") - 1)).alias("block"), "size"), "visitors")
    met = visitors.groupBy("tile", "home").agg(F.first("size").alias("size"))
    homes = open_.withColumnRenamed("band", "home").join(met, ["tile", "home"])
    homes = homes.select("tile", "home", "node", "label", F.pmod(F.xxhash64("node"), blocks("size")).cast("int").alias("block"), F.lit(False).alias("visits"), (F.col("label") == F.col("major")).alias("major"))
    rows = visitors.select("tile", "home", "node", "label", "block", F.lit(True).alias("visits"), F.lit(False).alias("major")).union(homes)
    # Ids alone go to where the bitmaps are, if they are few: else all bitmaps would travel for the sake of some.
    rows = _small(stage(rows, "meetings")).join(nodes.select("node", "n", F.col(bitmaps).alias("bits")), "node")
    names = ["tile", "home", "block", "visits", "major", "node", "label", "n", "bits"]

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the homes of a group that may go on
        for batch in batches:
            got = pa.Table.from_batches([*([held] if held else []), batch]).combine_chunks()
            tile, home, block, node, label, n = (got.column(c).to_numpy() for c in ("tile", "home", "block", "node", "label", "n"))
            visits, major = (np.array(got.column(c).to_pylist(), dtype=bool) for c in ("visits", "major"))
            new = (tile[1:] != tile[:-1]) | (home[1:] != home[:-1]) | (block[1:] != block[:-1])
            group = np.concatenate((np.zeros(min(1, len(tile)), np.int64), np.cumsum(new)))
            i, j, more = best_pairs(group, visits, major, node, label, n, got.column("bits").to_pylist(), percent, best)
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(tile[i]), pa.array(more)], names=["a", "b", "tile", "more"])
            last = np.flatnonzero((group == group[-1]) & ~visits) if len(group) else []
            held = got.take(pa.array(last)).combine_chunks().to_batches()[0] if len(last) else None

    dealt = rows.select(*names).repartition("tile", "home", "block").sortWithinPartitions("tile", "home", "block", "visits")
    return dealt.mapInArrow(lean(compare), "a long, b long, tile long, more boolean")


def _merged(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """The components that new links make of those before: (node, label) of every node that has a link."""
    if labels is None:
        return components(found)
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    links = found.join(of("a"), "a", "left").join(of("b"), "b", "left")
    links = stage(links.select("a", "b", F.coalesce("label_a", "a").alias("x"), F.coalesce("label_b", "b").alias("y")), "merges")
    ends = links.select(F.col("a").alias("node"), F.col("x").alias("label")).union(links.select("b", "y"))
    above = components(links.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    above = above.select(F.col("node").alias("label"), F.col("label").alias("new"))
    both = labels.union(ends).distinct().join(_small(above), "label", "left")
    return stage(both.select("node", F.coalesce("new", "label").alias("label")), "labels")


def labelled(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row per document: id, text_hash, n (shingles), label (the same for a component; null for empty sets)."""
    ship(docs.sparkSession)
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs.select(text_col), words))
    sets = stage(_sets(docs, id_col, text_col, words, percent, frequent), "sets")
    filled = sets.filter("n > 0")
    one = lambda c: F.first(c).alias(c)
    grouped = filled.groupBy("node").agg(one("n"), one("bits"), one("sig"), one("text_hash"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    keys = filled.agg(F.sum(F.octet_length("keys")) / 8).first()[0]
    # The keys' shuffle is the largest: it is made while little else is on disk, and deleted before the next.
    tiles = stage(_tiles(filled, int(keys or 0)), "tiles")
    swept(docs.sparkSession)
    nodes = stage(grouped, "nodes")
    swept(docs.sparkSession)
    if nodes.filter("lo <> hi").limit(1).count():
        raise RuntimeError("two different sets have one 64-bit node id")
    tried = labels = None

    def compared(pairs: DataFrame, *bitmaps: str) -> bool:
        """Have new pairs (a, b) compared, first by these bitmaps, and the components updated; whether there was any."""
        nonlocal tried, labels
        near = stage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "new")
        for column in bitmaps:
            near = stage(_near(near, nodes, percent, column), "near")
        if tried is not None and not near.limit(1).count():
            return False
        found = stage(_verified(near, docs, nodes, text_col, words, percent), "found")
        tried, labels = near if tried is None else tried.union(near), _merged(labels, found)
        swept(docs.sparkSession)
        return True

    for drawn in ROUNDS:
        compared(_stars(tiles, drawn, labels), "sig", "bits")
    best = BEST
    while True:
        # Many sets meet at first, by narrow bitmaps; the few tiles that are taken up again are told by the whole ones.
        sent = stage(_open_pairs(tiles, nodes, labels, percent, best, "sig" if best == BEST else "bits"), "open")
        again = sent.filter("more").select("tile").distinct()
        compared(sent.select("a", "b").distinct(), "bits")
        if not again.limit(1).count():
            break
        tiles, best = stage(tiles.join(_small(again), "tile", "left_semi"), "tiles"), best * MORE
    named = sets.join(labels, "node", "left")
    return named.select(id_col, "text_hash", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"))


def join(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """A row per document: id, n_shingles, component_id (the smallest id reachable by links)."""
    rows = stage(labelled(docs, id_col=id_col, **options), "labelled")
    least = rows.filter("n > 0").groupBy("label").agg(F.min(id_col).alias("component_id"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(id_col))
    return rows.join(least, "label", "left").select(id_col, F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The document of the smallest id of each component (a null id comes last); documents without words stay."""
    rows = stage(labelled(docs, id_col=id_col, text_col=text_col, **options), "labelled")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "text_hash")).alias("m")
    kept = rows.filter("n > 0").groupBy("label").agg(first).select(F.col("m.id").alias("__id"), F.col("m.text_hash").alias("__hash"))
    kept = kept.union(rows.filter("n = 0").select(id_col, "text_hash").distinct())
    own = free("own", docs.columns)
    kept = kept.select(F.col("__id").alias(kept_id := free("id", docs.columns)), F.col("__hash").alias(kept_hash := free("hash", docs.columns)))
    hashed = docs.withColumn(own, F.xxhash64(text_col))
    out = hashed.join(kept, (F.col(own) == F.col(kept_hash)) & F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
    if rows.filter("n > 0").groupBy(id_col, "text_hash").count().filter("count > 1").limit(1).count():
        empty = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        out = out.filter(empty).union(out.filter(~empty).dropDuplicates([id_col, own]))
    return out.drop(own)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


# Sets of shingles, links by counting common ones, components by reachability.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s FROM w, unnest(range(1, greatest(2, len(w) - 3))) AS t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
near(a, b) AS (SELECT a, b FROM links UNION SELECT near.a, links.b FROM near JOIN links ON links.a = near.b)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM near WHERE near.a = w.doc_id), doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""
