"""A reader's and writer's view of one versioned table: transactions over several steps, which read their own writes, and
the log of what was committed since the last checkpoint. In memory, or over a Store."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.mutate import checked_batch, delete_delta, put
from palimpsest.operators.visible import find_at, newest, visible
from palimpsest.sources.store import Store


class Session:
    def __init__(self, entries: DataFrame, key: Sequence[str], store: Store | None = None):
        self.key, self.store, self._base = list(key), store, entries
        top = entries.agg(F.max("seq")).first()[0]
        self.next_seq = 0 if top is None else int(top) + 1
        self.log: list[DataFrame] = []

    @classmethod
    def memory(cls, entries: DataFrame, key: Sequence[str]) -> Session:
        return cls(entries, key)

    @classmethod
    def over(cls, store: Store) -> Session:
        return cls(store.entries(), store.state["key"], store)

    def entries(self) -> DataFrame:
        """All versions, those committed in this session too."""
        if self.store is not None:
            return self.store.entries()
        out = self._base
        for delta in self.log:
            out = out.unionByName(delta)
        return out

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """All of its steps are committed at its end, or none, if it is left by an exception."""
        tx = Transaction(self)
        yield tx
        if not tx.steps:
            return
        delta = newest(tx.pending(), self.key)
        if self.store is not None:
            self.store.commit(delta)
        self.log.append(delta)
        self.next_seq = tx.next_seq

    def drain(self) -> list[DataFrame]:
        """The deltas since the last drain, oldest first, for a log to write; a store has them already."""
        out, self.log = self.log, []
        if self.store is None:
            for delta in out:
                self._base = self._base.unionByName(delta)
        return out


class Transaction:
    def __init__(self, session: Session):
        self.session, self.steps, self.next_seq = session, [], session.next_seq

    def pending(self) -> DataFrame:
        out = self.steps[0]
        for step in self.steps[1:]:
            out = out.unionByName(step)
        return out

    def entries(self) -> DataFrame:
        """What a read inside the transaction sees: its own steps are the newest."""
        own = self.session.entries()
        return own.unionByName(self.pending()) if self.steps else own

    def _add(self, step: DataFrame) -> None:
        self.steps.append(step.select(*self.session.entries().columns))
        self.next_seq += step.count()

    def put(self, rows: DataFrame, snap: int) -> None:
        """Rows of keys and values as live entries."""
        self._add(checked_batch(put(rows, snap, self.next_seq, self.session.key), self.session.key))

    def delete(self, targets: DataFrame, chain: Sequence[int]) -> None:
        """Tombstones of those target keys that are visible, this transaction's own writes among them."""
        self._add(delete_delta(self.entries(), targets, self.session.key, chain, self.next_seq))

    def find_at(self, where: Column, snap: int) -> DataFrame:
        return find_at(self.entries(), self.session.key, where, snap)

    def find_visible(self, where: Column, chain: Sequence[int]) -> DataFrame:
        return visible(self.entries().filter(where), self.session.key, chain)

    def truncate(self, n: int) -> None:
        """Forget all steps but the first n."""
        self.steps = self.steps[:n]
