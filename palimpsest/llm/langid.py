"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of variable order is counted on a bounded sample of labelled
documents and then frozen. A byte's probability is that of its longest known context; a byte not seen there
escapes (method C) to the next shorter one, with the bytes seen in longer contexts excluded, down to a
uniform order -1. A text's code length under each language is the sum over all its bytes; the shortest wins.

As the statistics are frozen, the longest known context is a state of a finite automaton, and each state's
256 code lengths under every language are a table. Texts are scored many pieces at a time, a byte of each a
step; a piece starts a few bytes early, so its state is the one that the whole text would have there.

Cases: null texts and texts without a letter are `und` with score 0; very long texts are scored whole;
ties go to the first language in order; repeated rows are scored each; rows without an id are neither learnt from nor
held out; an empty table, or one without
labelled rows to learn from, predicts `und` throughout; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import lean, ship, table

#: The sample: so many documents of each language, of at most so many bytes each. All others are scored.
SAMPLE_DOCS = 150
SAMPLE_BYTES = 16_384
ORDER = 4
#: Times the sample that the first look for it lets through.
SPARE = 8
#: Contexts of a tree, the most frequent first; shorter ones come before longer ones.
CONTEXTS = 6_000
#: Bytes of a piece that is scored in step with others.
PIECE = 512
#: Bits a byte of the shortest code above which a text is in no learned language.
FOREIGN = 6.0


class Model:
    """The automaton and, for each language, the code lengths in bits."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER, contexts: int = CONTEXTS):
        self.langs = sorted(samples)
        self.order = order
        trees = [_tree(samples[lang], order, contexts) for lang in self.langs]
        # A suffix of a kept context is kept too, so the states are closed under dropping first bytes.
        names = sorted({b""}.union(*trees), key=lambda c: (len(c), c))
        state = {c: i for i, c in enumerate(names)}
        n = len(names)
        self.next = np.zeros((n, 256), dtype=np.int32)
        # A state's code lengths in a language are those of its longest suffix in the tree: each row is held once.
        self.row = np.zeros((n, max(1, len(trees))), dtype=np.int32)
        self.cost = np.zeros((max(1, sum(map(len, trees))), 256), dtype=np.float32)
        n_rows = 0
        for c, i in state.items():
            if c:
                self.next[i] = self.next[state[c[1:]]]
            if len(c) < order:
                for d in range(256):
                    if (to := state.get(c + bytes((d,)))) is not None:
                        self.next[i, d] = to
        for k, tree in enumerate(trees):
            memo: dict[bytes, int] = {}
            for c, i in state.items():
                own = c
                while own not in tree:
                    own = own[1:]
                if own not in memo:
                    memo[own] = n_rows * 256
                    self.cost[n_rows] = _code_lengths(own, tree)
                    n_rows += 1
                self.row[i, k] = memo[own]
        self.next = self.next.reshape(-1).astype(np.uint16 if n <= 1 << 16 else np.int32)
        self.cost = self.cost.reshape(-1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        pieces = [(i, a, min(a + PIECE, len(t))) for i, t in enumerate(texts) for a in range(0, len(t), PIECE)]
        pieces.sort(key=lambda p: p[1] - p[2])
        for lot in range(0, len(pieces), 4096):
            part = pieces[lot : lot + 4096]
            sizes = np.array([b - a for _, a, b in part])
            lead = np.array([min(self.order, a) for _, a, _ in part])
            grid = np.zeros((len(part), self.order + int(sizes.max())), dtype=np.uint8)
            for r, (i, a, b) in enumerate(part):
                got = np.frombuffer(texts[i], dtype=np.uint8, count=b - a + lead[r], offset=a - lead[r])
                grid[r, self.order - lead[r] : self.order + b - a] = got
            grid = np.ascontiguousarray(grid.T)
            at = np.zeros(len(part), dtype=np.int64)
            bits = np.zeros((len(part), self.row.shape[1]))
            for s in range(self.order):
                at = np.where(lead >= self.order - s, self.next[at * 256 + grid[s]].astype(np.int64), 0)
            live = np.searchsorted(-sizes, -np.arange(int(sizes.max())), side="left")  # pieces that are longer
            for s, n in enumerate(live.tolist()):
                byte = grid[self.order + s, :n]
                bits[:n] += self.cost.take(self.row.take(at[:n], axis=0) + byte[:, None])
                here = at[:n] * 256 + byte
                at = self.next.take(here).astype(np.int64)
            np.add.at(out, [i for i, _, _ in part], bits[:, : len(self.langs)])
        return out


def _tree(texts: list[bytes], order: int, contexts: int) -> dict[bytes, tuple[np.ndarray, np.ndarray]]:
    """Context to the bytes that follow it, and their counts. Order by order the most frequent contexts, of those
    whose suffix is kept."""
    all_ = np.zeros(256, dtype=np.int64)
    for t in texts:
        all_ += np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256)
    tree = {b"": (np.flatnonzero(all_).astype(np.uint8), all_[all_ > 0].astype(np.int32))}
    for k in range(1, order + 1):
        codes = [np.zeros(0, dtype=np.uint64)]
        for t in texts:
            b = np.frombuffer(t, dtype=np.uint8).astype(np.uint64)
            if len(b) > k:
                codes.append(sum(b[j : len(b) - k + j] << np.uint64(8 * (k - j)) for j in range(k + 1)))
        grams, counts = np.unique(np.concatenate(codes), return_counts=True)
        heads, first = np.unique(grams >> np.uint64(8), return_index=True)
        totals = np.add.reduceat(counts, first) if len(heads) else np.zeros(0, dtype=np.int64)
        room = contexts - len(tree)
        ends = np.append(first, len(grams))
        for i in np.lexsort((heads, -totals)):
            if room <= 0 or totals[i] < 2:
                break
            name = int(heads[i]).to_bytes(k, "big")
            if name[1:] in tree:
                own = slice(ends[i], ends[i + 1])
                tree[name] = ((grams[own] & np.uint64(0xFF)).astype(np.uint8), counts[own].astype(np.int32))
                room -= 1
    return tree


def _code_lengths(context: bytes, tree: dict[bytes, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    bits, escaped, out = np.zeros(256), np.ones(256, dtype=bool), 0.0
    while True:
        counts = np.zeros(256, dtype=np.int64)
        follow, times = tree[context]
        counts[follow] = times
        counts[~escaped] = 0
        seen = counts > 0
        kinds, total = int(seen.sum()), int(counts.sum())
        if kinds:
            # Where every byte left is seen, there is nothing to escape to.
            base = total + (kinds if kinds < int(escaped.sum()) else 0)
            bits[seen] = out + np.log2(base) - np.log2(counts[seen])
            escaped &= ~seen
            if not escaped.any():
                return bits
            out += np.log2(base) - np.log2(kinds)
        if not context:
            bits[escaped] = out + np.log2(int(escaped.sum()))
            return bits
        context = context[1:]


def folded(text: str) -> bytes:
    """Lower-cased UTF-8, so that shouted text is of its language too."""
    return text.lower().encode()


def in_training(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 != 2


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the sample. Its rows are those with the smallest hashes of their ids, so that it does not
    depend on how the table is dealt; the driver holds SAMPLE_DOCS * SAMPLE_BYTES of each language at most."""
    trains = in_training(id_col) & F.col(lang_col).isNotNull()
    fits = trains & F.octet_length(text_col).between(1, SAMPLE_BYTES)
    hashed = F.xxhash64(F.col(id_col), F.col(text_col))
    # Of n rows the least hashes lie below a bound that some more pass than are wanted: only those leave their tasks. Where
    # it was too low after all, it is raised, up to all rows.
    shares = {r.l: min(1.0, SPARE * SAMPLE_DOCS / r.n) for r in docs.filter(trains).groupBy(F.col(lang_col).alias("l")).agg(F.count("*").alias("n")).collect()}
    keys: list[tuple[str, int]] = []
    while shares:
        bounds = F.create_map(*[F.lit(x) for lang, share in shares.items() for x in (lang, int((share - 0.5) * 2**64) if share < 1 else 2**63 - 1)])
        low = docs.filter(fits).select(F.col(lang_col).alias("l"), hashed.alias("h")).filter(F.col("h") <= F.try_element_at(bounds, F.col("l")))
        found: dict[str, list[int]] = {}
        for r in low.distinct().collect():
            found.setdefault(r.l, []).append(r.h)
        short = {lang: min(1.0, share * SPARE) for lang, share in shares.items() if share < 1 and len(found.get(lang, ())) < SAMPLE_DOCS}
        keys += [(lang, h) for lang in shares if lang not in short for h in sorted(found.get(lang, ()))[:SAMPLE_DOCS]]
        shares = short
    if not keys:
        return Model({})
    rows = docs.filter(fits & hashed.isin([h for _, h in keys])).select(F.col(lang_col).alias("l"), hashed.alias("h"), F.col(text_col).alias("t")).distinct().collect()
    wanted, samples = set(keys), {}
    for r in sorted(rows, key=lambda r: (r.l, r.h, r.t)):
        if (r.l, r.h) in wanted:
            samples.setdefault(r.l, []).append(folded(r.t))
    return Model(samples)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: id, keep..., lang_pred, score (the chosen language's share of the probability a byte
    that all learned languages give to the text), bits_per_byte (of the shortest code; null for `und`)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(dict.fromkeys([id_col, *keep, text_col]))
    kept = [c for c in columns if c == id_col or c in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(columns.index(text_col)).cast(pa.string()).to_pylist()
            ok = [i for i, t in enumerate(texts) if t and m.langs and any(map(str.isalpha, t))]
            langs, scores, rates = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            for lot in range(0, len(ok), 1024):
                part = ok[lot : lot + 1024]
                data = [folded(texts[i]) for i in part]
                bits = m.score(data) / np.array([len(t) for t in data])[:, None]
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(bits.min(axis=1)[:, None] - bits).sum(axis=1)
                for i, b, s, r in zip(part, best.tolist(), share.tolist(), bits.min(axis=1).tolist(), strict=True):
                    langs[i], scores[i], rates[i] = m.langs[b], s, r
            new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(columns.index(c)) for c in kept], *new], names=[*kept, "lang_pred", "score", "bits_per_byte"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*columns).mapInArrow(lean(run), f"{schema}, lang_pred string, score double, bits_per_byte double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", F.coalesce(~in_training("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")
