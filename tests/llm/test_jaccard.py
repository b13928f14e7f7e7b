import random
import re

import numpy as np

from palimpsest.llm import components as c
from palimpsest.llm import jaccard as j

SCHEMA = "doc_id long, text string, node string, n long, component_id string"


def shingle_set(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min([x for x in (d, least.get(root(i))) if x is not None], default=None)
    return sorted(((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, groups=12, size=9):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([6, 20, 60, 120]))]
        if rnd.random() < 0.5:
            base[len(base) // 2 : 0] = passage
        for _ in range(rnd.randint(1, size)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append(" ".join(copy) if rnd.random() < 0.8 else "\n ".join(copy).upper())
    rows += [None, "", " \t", "one two", "One two", "one two three", "É é", "é é", "a b c d e", "A b c d e"]
    rnd.shuffle(rows)
    return [(i if i % 17 else None, t) for i, t in enumerate(rows)] + [(5, rows[5]), (5, rows[5]), (999, "x y z " * 20_000)]


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA).repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.join(docs).collect()), key=str)


def pairs(sets, visits, best, labels=None):
    """best_pairs() of one group, homes first, as places in `sets`."""
    order = sorted(range(len(sets)), key=lambda i: visits[i])
    bits = [j.folded(j.bitmap(sets[i]), j.sig_words(len(sets[i]))).tobytes() for i in order]
    n, ids = np.array([len(sets[i]) for i in order]), np.array(order, dtype=np.int64)
    flags = np.array([visits[i] for i in order])
    label = ids if labels is None else np.array([labels[i] for i in order])
    i, k, more = j.best_pairs(np.zeros(len(order), np.int64), flags, ~flags, ids, label, n, bits, 75, best)
    return [(order[x], order[y], bool(m)) for x, y, m in zip(i, k, more, strict=True)]


def test_best_pairs(monkeypatch):
    base = np.arange(1, 401, dtype=np.uint64)
    near = [j.mixed(np.sort(np.concatenate((base[d:], base[:d] + np.uint64(10_000))))) for d in (0, 5, 10, 20, 300)]
    visits = [True, False, False, False, False]
    for size in (1, 7, 1 << 19):
        monkeypatch.setattr(j, "AT_ONCE", size)
        assert pairs(near, visits, 2) == [(0, 1, True), (0, 2, True)]
        assert pairs(near, visits, 3) == [(0, 1, False), (0, 2, False), (0, 3, False)]
        assert pairs(near, visits, 3, [7, 7, 1, 2, 3]) == [(0, 2, False), (0, 3, False)]
        assert pairs(near, [True] * 5, 3) == pairs(near, [False] * 5, 3) == []


def test_shingles_and_bound():
    rnd = random.Random(1)
    texts = [t for _, t in corpus(3)]
    sets = [j.shingles(t.encode() if t else None) for t in texts]
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    for _ in range(2000):
        a, b = rnd.randrange(len(sets)), rnd.randrange(len(sets))
        x, y = shingle_set(texts[a]), shingle_set(texts[b])
        want = bool(x & y) and 100 * len(x & y) >= 75 * len(x | y)
        assert j.similar(sets[a], sets[b]) == want
        if want:
            assert pairs([sets[a], sets[b]], [True, False], best=1) == [(0, 1, False)]


def test_against_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_small_limits_change_nothing(spark, monkeypatch):
    rows = corpus(2, groups=8, size=14)
    for name, value in (("FREQUENT", 4), ("LOT", 300), ("BLOCK", 3), ("BUCKET_KEYS", 50), ("BROADCAST_BYTES", 20)):
        monkeypatch.setattr(j, name, value)
    assert run(spark, rows) == brute(rows)


def test_what_the_star_leaves_open(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK", 3)
    monkeypatch.setattr(j, "BEST", 1)
    monkeypatch.setattr(j, "MORE", 2)
    # The star draws nothing: every pair must come from the tiles' open pairs.
    stars = j._stars
    monkeypatch.setattr(j, "_stars", lambda *x: stars(*x).limit(0))
    rows = corpus(4, groups=6)
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, [(1, "a b c d e f")])[0][2] == 1
    docs = spark.createDataFrame([], SCHEMA)
    assert j.join(docs).count() == 0


def test_components_of_few_links_take_few_jobs(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    chain = rnd.permutation(np.arange(-300, 300))
    links = [*zip(chain[:-1].tolist(), chain[1:].tolist(), strict=True), *((1000 + int(a), 1000 + int(b)) for a, b in rnd.integers(0, 400, (220, 2)))]
    df = spark.createDataFrame(links, "a long, b long")
    up = {n: n for link in links for n in link}
    while any(up[a] != up[b] for a, b in links):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    sc = spark.sparkContext
    sc.setJobGroup("few-links", "")
    got = c.components(df)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("few-links")) <= 6
    assert {tuple(r) for r in got.collect()} == set(up.items())
    assert c.components(df.limit(0)).collect() == []
    monkeypatch.setattr(c, "GATHERED", 0)
    assert sorted(tuple(r) for r in c.components(spark.createDataFrame([(3, 7), (5, 7), (4, 9)], "a long, b long")).collect()) == [(3, 3), (4, 4), (5, 3), (7, 3), (9, 4)]


def test_large_shuffles_are_not_on_disk_together(spark, monkeypatch):
    done = []
    stage, swept = j.stage, j.swept
    monkeypatch.setattr(j, "stage", lambda df, label, **o: (done.append(label), stage(df, label, **o))[1])
    monkeypatch.setattr(j, "swept", lambda s: (done.append("swept"), swept(s))[1])
    rows = corpus(5)
    got = j.join(spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert done.index("tiles") < done.index("swept") < done.index("nodes") and "meetings" in done
