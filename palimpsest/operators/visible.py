"""Versions and what is visible of them.

An entry is a row with key columns, snap_id, kind, seq and value columns. Two rules stand below everything:

* the newest entry of a (key, snap_id) is the one of the highest seq; the others do not exist;
* of a key's newest entries on a reader's chain of snapshots, the one of the smallest snap_id, the closest,
  decides: if it is live it is seen, if it is a tombstone the key is hidden.

Both are aggregations with a partial one before the shuffle, and the chain's filter stands below them, where a scan can
use it. Where all values have a fixed width they are hash aggregations, a column each, which need no sort; else the
rest of a row is one struct. The kind is looked at last: earlier would bring deleted rows back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.keys import LIVE

META = ("snap_id", "kind", "seq")


def _rest(entries: DataFrame, given: Sequence[str]) -> list[str]:
    return [c for c in entries.columns if c not in given]


_FIXED = ("boolean", "byte", "short", "integer", "long", "float", "double", "date", "timestamp")


def _fixed(entries: DataFrame, columns: Sequence[str]) -> bool:
    return all(entries.schema[c].dataType.typeName() in _FIXED for c in columns)


def newest(entries: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row for each (key, snap_id): that of the highest seq."""
    rest = _rest(entries, [*key, "snap_id"])
    grouped = entries.groupBy(*key, "snap_id")
    if _fixed(entries, rest):
        own = [F.max("seq").alias("seq") if c == "seq" else F.max_by(c, "seq").alias(c) for c in rest]
        return grouped.agg(*own).select(*key, "snap_id", *rest)
    return grouped.agg(F.max_by(F.struct(*rest), "seq").alias("e")).select(*key, "snap_id", "e.*")


def deciding(entries: DataFrame, key: Sequence[str], chain: Sequence[int]) -> DataFrame:
    """One row for each key that has a version on the chain: the one that decides, live or not."""
    rest = _rest(entries, key)
    on_chain = entries.filter(F.col("snap_id").isin([int(s) for s in chain]))
    if _fixed(entries, rest):
        own = [F.min("snap_id").alias(c) if c == "snap_id" else F.min_by(c, "snap_id").alias(c) for c in rest]
        return newest(on_chain, key).groupBy(*key).agg(*own).select(*key, *rest)
    order = F.struct("snap_id", -F.col("seq"))
    return on_chain.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("e")).select(*key, "e.*")


def visible(entries: DataFrame, key: Sequence[str], chain: Sequence[int]) -> DataFrame:
    """With the owning snapshot in snap_id."""
    return deciding(entries, key, chain).filter(F.col("kind") == LIVE)


def live(entries: DataFrame, key: Sequence[str]) -> DataFrame:
    """The live newest entries of all snapshots."""
    return newest(entries, key).filter(F.col("kind") == LIVE)


def find_at(entries: DataFrame, key: Sequence[str], where: Column, snap: int) -> DataFrame:
    """Exactly at a snapshot, without its ancestors; a tombstone is nothing."""
    return live(entries.filter(where & (F.col("snap_id") == snap)), key)


def merge_runs(runs: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Several runs as one, of equal (key, snap_id) the highest seq."""
    both = runs[0]
    for run in runs[1:]:
        both = both.unionByName(run)
    return newest(both, key)


def exclusive(entries: DataFrame, key: Sequence[str], chain: Sequence[int]) -> DataFrame:
    """Visible rows, and whether the reader's own snapshot holds them."""
    return visible(entries, key, chain).withColumn("own", F.col("snap_id") == int(chain[0]))


def view_diff(entries: DataFrame, key: Sequence[str], chain_a: Sequence[int], chain_b: Sequence[int], value: Sequence[str]) -> DataFrame:
    """Keys that two readers see differently, with both values (null: not seen). One pass over the versions."""
    both = newest(entries.filter(F.col("snap_id").isin([*map(int, chain_a), *map(int, chain_b)])), key)
    aggs = []
    for side, line in (("a", chain_a), ("b", chain_b)):
        order = F.when(F.col("snap_id").isin([int(s) for s in line]), F.col("snap_id"))  # null orders are passed over
        aggs += [F.min_by(c, order).alias(f"{side}_{c}") for c in ("kind", *value)]
    seen = both.groupBy(*key).agg(*aggs)
    shown = lambda side, c: F.when(F.col(f"{side}_kind") == LIVE, F.col(f"{side}_{c}"))
    there = lambda side: F.coalesce(F.col(f"{side}_kind") == LIVE, F.lit(False))
    differs = there("a") != there("b")
    for c in value:
        differs |= ~shown("a", c).eqNullSafe(shown("b", c))
    return seen.filter(differs).select(*key, *[shown("a", c).alias(f"a_{c}") for c in value], *[shown("b", c).alias(f"b_{c}") for c in value])


def version_counts(entries: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored and surviving versions of each snapshot and kind."""
    own = newest(entries, key).groupBy("snap_id", "kind").agg(F.count("*").alias("n_newest"))
    stored = entries.groupBy("snap_id", "kind").agg(F.count("*").alias("n_stored"))
    return stored.join(own, ["snap_id", "kind"], "left").select("snap_id", "kind", "n_stored", F.coalesce("n_newest", F.lit(0)).alias("n_newest"))
