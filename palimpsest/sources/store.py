"""A durable versioned table: Parquet versions, an append-only log of deltas, and a manifest that names both.

A commit is one new folder and one new manifest, written under the next number by a rename that no other
writer can have won; readers take the highest manifest whose checksum holds. There is one writer at a time:
a second one's commit fails, and changes nothing. A checkpoint rewrites base and deltas as a compacted base.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.errors import AlreadyExists, Corrupt, NotFound
from palimpsest.operators.journal import groups, next_seq, valid_prefix
from palimpsest.operators.visible import newest

VERSION = 1


class Store:
    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path.rstrip("/"), state

    # -- manifests

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    @classmethod
    def _numbers(cls, spark: SparkSession, path: str) -> list[int]:
        fs, Path = cls._fs(spark, path)
        if not fs.exists(Path(f"{path}/manifests")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(Path(f"{path}/manifests"))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d{20})\.json", n)))

    def _publish(self, state: dict) -> None:
        fs, Path = self._fs(self.spark, self.path)
        body = json.dumps(state, sort_keys=True)
        text = json.dumps({"crc": zlib.crc32(body.encode()), "state": state})
        final = Path(f"{self.path}/manifests/{state['number']:020d}.json")
        if fs.exists(final):
            raise AlreadyExists("another writer has made this commit")
        # A number is claimed by making a file that must not be there: of two writers one is refused. A claim whose writer
        # died is taken away by vacuum().
        claim = f"{self.path}/manifests/.{state['number']:020d}.claim"
        if not self._claimed(fs, Path, claim):
            raise AlreadyExists("another writer is making this commit")
        temp = Path(f"{self.path}/manifests/.{state['number']:020d}.{uuid.uuid4().hex}.tmp")
        out = fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(temp, final):
            raise AlreadyExists("another writer has made this commit")
        fs.delete(Path(claim), False)
        self.state = state

    def _claimed(self, fs, Path, claim: str) -> bool:
        if fs.getScheme() == "file":
            made = self.spark.sparkContext._jvm.java.io.File(Path(claim).toUri().getPath())
            made.getParentFile().mkdirs()
            return bool(made.createNewFile())
        try:
            fs.create(Path(claim), False).close()
        except Exception as e:  # noqa: BLE001  what the store throws depends on it
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    @classmethod
    def create(cls, spark: SparkSession, path: str, entries: DataFrame, key: Sequence[str]) -> Store:
        if cls._numbers(spark, path):
            raise AlreadyExists(path)
        store = cls(spark, path, {"version": VERSION, "number": 0, "key": list(key), "base": "base-0", "deltas": [], "next_seq": 0})
        entries.write.parquet(f"{store.path}/base-0")
        store._publish(store.state | {"next_seq": store._top_seq(entries) + 1})
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        """From the newest manifest that holds; one that was cut off is passed over."""
        numbers = cls._numbers(spark, path.rstrip("/"))
        if not numbers:
            raise NotFound(path)
        for number in reversed(numbers):
            try:
                text = "\n".join(r.value for r in spark.read.text(f"{path}/manifests/{number:020d}.json").collect())
                got = json.loads(text)
                if zlib.crc32(json.dumps(got["state"], sort_keys=True).encode()) != got["crc"]:
                    continue
            except (ValueError, KeyError):
                continue
            if got["state"]["version"] != VERSION:
                raise Corrupt(f"version {got['state']['version']} is not known")
            return cls(spark, path, got["state"])
        raise Corrupt("no manifest holds")

    # -- data

    @staticmethod
    def _top_seq(entries: DataFrame) -> int:
        top = entries.agg({"seq": "max"}).first()[0]
        return -1 if top is None else int(top)

    @property
    def next_seq(self) -> int:
        return self.state["next_seq"]

    def entries(self) -> DataFrame:
        """All stored versions; newest() of them is the state."""
        return self.spark.read.parquet(*[f"{self.path}/{x}" for x in (self.state["base"], *self.state["deltas"])])

    def commit(self, delta: DataFrame, **more) -> None:
        """Append a delta, all of it or nothing. `more` goes into the manifest."""
        number = self.state["number"] + 1
        name = f"delta-{number}-{uuid.uuid4().hex[:8]}"  # a commit that lost leaves a folder that vacuum() takes
        delta.select(*self.entries().columns).write.parquet(f"{self.path}/{name}")
        top = self._top_seq(self.spark.read.parquet(f"{self.path}/{name}"))
        self._publish(self.state | {"number": number, "deltas": [*self.state["deltas"], name], "next_seq": max(self.next_seq, top + 1)} | more)

    def recover(self, frames: DataFrame) -> int:
        """Apply the log's complete groups that this store has not seen (frames of the entries' columns, with seq, is_commit
        and valid); how many operations that were. Done again, it changes nothing."""
        start = self.state.get("journal_seq", 0)
        found = groups(valid_prefix(frames, start))
        ops, after = found.filter(~F.col("is_commit")), next_seq(found, start).first().next_seq
        if n := ops.count():
            self.commit(ops.select(*self.entries().columns), journal_seq=int(after))
        return n

    def checkpoint(self) -> None:
        """A new base of the newest entries, sorted by key so that scans skip row groups."""
        number, key = self.state["number"] + 1, self.state["key"]
        name = f"base-{number}-{uuid.uuid4().hex[:8]}"
        newest(self.entries(), key).repartitionByRange(*key).sortWithinPartitions(*key, "snap_id").write.parquet(f"{self.path}/{name}")
        self._publish(self.state | {"number": number, "base": name, "deltas": []})

    def vacuum(self) -> list[str]:
        """Delete folders that the current manifest doesn't name; the names of those deleted."""
        fs, Path = self._fs(self.spark, self.path)
        kept = {self.state["base"], *self.state["deltas"], "manifests"}
        gone = [n for s in fs.listStatus(Path(self.path)) if (n := s.getPath().getName()) not in kept]
        for name in gone:
            fs.delete(Path(f"{self.path}/{name}"), True)
        for s in fs.listStatus(Path(f"{self.path}/manifests")):
            if s.getPath().getName().startswith("."):
                fs.delete(s.getPath(), False)
        return sorted(gone)
