"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are put into one suffix automaton over word numbers (several automata, a
block of items each, where a benchmark is very large). Documents stream through it once: the state
and the length of the longest match that ends at each word are tracked, and wherever that match holds
a whole window (`window` consecutive item words, or a whole shorter item), its words are hit.

Cases: null, empty and word-less texts have no words and are clean; items without words are ignored;
repeated items and rows are each reported; items without an id are one item, which counts and is not listed; an
empty benchmark hits nothing; no text is cut; only the
named columns of the inputs are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import lean, ship, table

WINDOW = 10
#: Words of one automaton; a larger benchmark is dealt into blocks of whole items, one automaton each.
BLOCK_WORDS = 2_000_000
#: Bytes of texts that a benchmark may have, as every task holds it.
BENCHMARK_BYTES = 64_000_000

#: On the text before its letters are lowered.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: On UTF-8 bytes: A-Z to a-z, every other ASCII byte that is not a word's to a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    # split() parts at ASCII white space only, and a folded text holds none but spaces
    return text.translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Of several word sequences (items), for windows of `window` words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items = [name for name, _ in items]
        coded = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for _, ws in items]
        for seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        n = len(self.link)
        self.of: list[list[int]] = [[] for _ in range(n)]  # items that hold the strings of a state
        self.short: list[tuple[tuple[int, int], ...]] = [()] * n  # (length, item) of whole short items
        for i, seq in enumerate(coded):
            self._mark(i, seq)
        self.least = min((min(window, len(s)) for s in coded if s), default=0)
        self._home = [-2] * n
        self._shorts: dict[int, tuple[tuple[int, int], ...]] = {}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _mark(self, item: int, seq: list[int]) -> None:
        state = 0
        for c in seq:
            state = self.next[state][c]
            s = state
            while s > 0 and (not self.of[s] or self.of[s][-1] != item):
                self.of[s].append(item)
                s = self.link[s]
        if 0 < len(seq) < self.window:
            self.short[state] += ((len(seq), item),)

    def _window_state(self, state: int) -> int:
        """The state of the last `window` words of a match at `state`."""
        home = self._home[state]
        if home == -2:
            s = state
            while self.link[s] >= 0 and self.length[self.link[s]] >= self.window:
                s = self.link[s]
            home = self._home[state] = s
        return home

    def _short_items(self, state: int) -> tuple[tuple[int, int], ...]:
        """Whole short items that are suffixes of the strings of `state`."""
        if state not in self._shorts:
            found, s = (), state
            while s > 0:
                found += self.short[s]
                s = self.link[s]
            self._shorts[state] = found
        return self._shorts[state]

    def scan(self, ws: list[bytes], hit: bytearray) -> set[int]:
        """Mark hit words in `hit`; the items with a window that occurs."""
        found: set[int] = set()
        if not self.least:
            return found
        ids = np.fromiter(map(self.vocab.get, ws, _minus_ones(len(ws))), dtype=np.int64, count=len(ws))
        # A word of no item puts the automaton back at its root, so only runs of known words that
        # can hold a window are walked.
        known = np.concatenate(([False], ids >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for a, b in edges[edges[:, 1] - edges[:, 0] >= self.least].tolist():
            state = size = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while (to := nxt[state].get(c)) is None and state:
                    state = link[state]
                    size = length[state]
                if to is None:
                    size = 0
                    continue
                state, size = to, size + 1
                if size >= window:
                    hit[i - window + 1 : i + 1] = b"\x01" * window
                    found.update(self.of[self._window_state(state)])
                for n, item in self._short_items(state):
                    if n <= size:
                        hit[i - n + 1 : i + 1] = b"\x01" * n
                        found.add(item)
        return found


def _minus_ones(n: int) -> Iterator[int]:
    from itertools import repeat

    return repeat(-1, n)


def automata(rows: list[tuple[str, bytes | None]], window: int = WINDOW) -> list[SuffixAutomaton]:
    """Of (item_id, text) rows, in blocks of at most BLOCK_WORDS words (one item at least)."""
    split = [(name, words(text)) for name, text in rows]
    total, blocks = 0, []
    for name, ws in split:
        blocks.append(total // BLOCK_WORDS)
        total += len(ws)
    pairs = zip(blocks, split, strict=True)
    return [SuffixAutomaton([x for _, x in group], window) for _, group in groupby(pairs, key=lambda p: p[0])]


def _spans(hit: bytearray) -> list[tuple[int, int]]:
    mask = np.concatenate(([0], np.frombuffer(bytes(hit), dtype=np.uint8), [0]))
    return [tuple(x) for x in np.flatnonzero(mask[1:] != mask[:-1]).reshape(-1, 2).tolist()]


def scan_text(text: bytes | None, autos: list[SuffixAutomaton]) -> tuple[int, bytearray, int, list[str]]:
    """Its words, which of them are hit, how many items' windows occur, and the ids of those that have one."""
    ws = words(text)
    hit = bytearray(len(ws))
    items = {a.items[i] for a in autos for i in a.scan(ws, hit)}
    return len(ws), hit, len(items), sorted(i for i in items if i is not None)


def remove_spans(text: str, hit: bytearray) -> str:
    """The text without its hit words and what stands between two words of one span."""
    spans, kept, at = _spans(hit), [], 0
    places = [m.span() for m in _WORD.finditer(text)]
    for a, b in spans:
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join(kept) + text[at:]


def benchmark_rows(benchmark: DataFrame, id_col: str, text_col: str) -> list[tuple[str, bytes | None]]:
    """The stated test set, which each task holds as automata: its size does not follow the corpus, and is checked."""
    size = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    if size > BENCHMARK_BYTES:
        raise ValueError(f"a benchmark of {size} bytes; tasks hold {BENCHMARK_BYTES} at most: give it in parts, each cleaned after the other")
    got = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    return sorted(((r.i, bytes(r.t) if r.t is not None else None) for r in got.collect()), key=lambda x: x[0] or "")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
    max_coverage: float = 0.5,
    min_span: int = 1,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """A row per document: id, keep..., its words, hits and items, the text without the spans of at least `min_span`
    hit words (`clean_text`), and whether over `max_coverage` of its words are hit (`drop`)."""
    ship(docs.sparkSession)
    auto_var = docs.sparkSession.sparkContext.broadcast(automata(benchmark_rows(benchmark, item_col, text_col), window))
    kept = list(dict.fromkeys([id_col, *keep]))
    if taken := {"n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text", "drop"} & set(kept):
        raise ValueError(f"these columns cannot be kept beside the result's: {sorted(taken)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        autos = auto_var.value
        for batch in batches:
            rows = []
            for text in batch.column(len(kept)).cast(pa.binary()).to_pylist():
                n, hit, n_items, items = scan_text(text, autos)
                n_hit = sum(hit)
                clean = None if text is None else text.decode()
                if n_hit:
                    for a, b in _spans(hit):
                        if b - a < min_span:
                            hit[a:b] = bytes(b - a)
                    clean = remove_spans(clean, hit)
                digest = hashlib.sha256(",".join(items).encode()).hexdigest()
                rows.append((n, n_hit, n_items, digest, n_hit > 0, clean if n_hit else None, n_hit > max_coverage * n))
            names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text", "drop"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.bool_()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*kept, *names])

    head = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    schema = f"{head}n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, clean_text string, drop boolean"
    return docs.select(*kept, F.col(text_col).alias("__text")).mapInArrow(lean(run), schema)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP7_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS s
  FROM iw, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(p) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
spots AS (
  SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM dw, ks, unnest(range(1, len(w) - k + 2)) AS t(p) WHERE len(w) >= k),
hits AS (SELECT a.doc_id, a.p, a.k, win.item_id FROM spots a JOIN win ON win.k = a.k AND win.s = a.s),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hits, unnest(range(p, p + k)) AS t(q) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
