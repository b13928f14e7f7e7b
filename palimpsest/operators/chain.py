"""The snapshot tree. Ids fall from parent to child, 0 is no parent.

A tree may be as deep as it has snapshots, so nothing here takes a step for each level: pointers are doubled, and
log2(depth) rounds reach every ancestor. Each round's pointers are a written table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.staging import staged


def jumps(snapshots: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """(distance, (at, up)): each snapshot's ancestor at distance 1, 2, 4, ..., as long as any has one."""
    up = staged(snapshots.filter(F.col("parent_id") > F.col("snap_id")).select(F.col("snap_id").alias("at"), F.col("parent_id").alias("up")), "jumps")
    distance = 1
    while up.limit(1).count():
        yield distance, up
        further = up.select(F.col("at").alias("up"), F.col("up").alias("far"))
        up = staged(up.join(further, "up").select("at", F.col("far").alias("up")), "jumps")
        distance *= 2


def closure(snapshots: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(start, snap_id, depth): each head (each snapshot, if none are given) and all its ancestors, itself first."""
    own = (snapshots if heads is None else heads).select(F.col("snap_id").alias("start"), "snap_id", F.lit(0).alias("depth"))
    for distance, up in jumps(snapshots):
        # Known are the ancestors nearer than this distance: each of them leads to one as far beyond it.
        further = own.join(up, F.col("snap_id") == F.col("at")).select("start", F.col("up").alias("snap_id"), (F.col("depth") + distance).alias("depth"))
        own = staged(own.union(further), "closure")
    return own


def chains(snapshots: DataFrame, heads: Sequence[int]) -> dict[int, list[int]]:
    """The chains of a few readers, each closest first. Ancestors have larger ids, so they come by in one ordered pass, of
    which nothing but the chains is kept."""
    lines = {int(h): [int(h)] for h in heads}
    waiting: dict[int, list[list[int]]] = {h: [line] for h, line in lines.items()}
    if not lines:
        return lines
    above = snapshots.filter(F.col("snap_id") >= min(lines)).select("snap_id", "parent_id").orderBy("snap_id")
    for snap, parent in above.toLocalIterator():
        for line in waiting.pop(snap, ()):
            if parent > snap:
                line.append(parent)
                waiting.setdefault(parent, []).append(line)
        if not waiting:
            break
    return lines


def chain(snapshots: DataFrame, head: int) -> list[int]:
    """A reader's chain. It is as long as the tree is deep, so the driver may hold it: it becomes the literal list
    that scans filter by."""
    return chains(snapshots, [head])[int(head)]


def reached(snapshots: DataFrame, heads: DataFrame) -> DataFrame:
    """(snap_id) of the heads and all their ancestors, each once: as many rows as snapshots, at most."""
    known = heads.select("snap_id").distinct()
    for _, up in jumps(snapshots):
        known = staged(known.union(known.join(up, F.col("snap_id") == F.col("at")).select(F.col("up").alias("snap_id"))).distinct(), "reached")
    return known


def below(snapshots: DataFrame, counts: DataFrame) -> DataFrame:
    """(snap_id, n): of counts (snap_id, n) the sum over each snapshot and all that descend from it."""
    total = counts.groupBy("snap_id").agg(F.sum("n").alias("n"))
    for _, up in jumps(snapshots):
        further = total.join(up, F.col("snap_id") == F.col("at")).select(F.col("up").alias("snap_id"), "n")
        total = staged(total.union(further).groupBy("snap_id").agg(F.sum("n").alias("n")), "below")
    return total


def is_ancestor(snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ancestor, of) pairs with is_ancestor, a snapshot being its own. Parents have larger ids, so each pair goes up by
    the longest jump that does not pass the ancestor, then by the next shorter one: a row for each pair, always."""
    rows = pairs.select("ancestor", "of").withColumn("here", F.col("of"))
    for _, up in reversed(list(jumps(snapshots))):
        met = rows.join(up, (F.col("here") == F.col("at")) & (F.col("up") <= F.col("ancestor")), "left")
        rows = staged(met.select("ancestor", "of", F.coalesce("up", "here").alias("here")), "climb")
    return rows.select("ancestor", "of", (F.col("here") == F.col("ancestor")).alias("is_ancestor"))
