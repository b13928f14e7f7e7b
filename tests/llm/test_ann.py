import math

import numpy as np

from palimpsest.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score double, rank string"


def brute(rows, asked, k=5):
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in ok:
        if q in asked:
            near = sorted((-(a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), i) for i, b in ok if i != q and len(a) == len(b))
            out += [(q, r + 1, i, round(-s, 12)) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0.0, "x") for i, v in rows], SCHEMA)
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in ann.search(df, df.filter("vec_id % 50 = 0"), **options).collect())


def test_all_candidates_are_brute_force(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(160)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] + [1.0] * 7), (304, [None] + [1.0] * 7), (305, [float("inf")] + [1.0] * 7), (350, [1.0, 2.0]), (351, [2.0, 1.0])]
    assert run(spark, rows, share=1.0, shard_rows=40) == brute(rows, set(range(0, 400, 50)))
    assert run(spark, rows[:3]) == brute(rows[:3], {0})
    assert run(spark, []) == [] and run(spark, rows[:1]) == []


def test_recall(spark):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(40, 32))
    rows = [(i, (centres[i % 40] + rnd.normal(size=32) * 0.5).tolist()) for i in range(3000)]
    want = {(q, i) for q, _, i, _ in brute(rows, set(range(0, 3000, 50)))}
    got = {(q, i) for q, _, i, _ in run(spark, rows, share=0.1)}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_ascent_takes_longest_prefixes_first():
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(500, 16))
    forest = ann.Forest(np.arange(500), vectors, trees=4)
    strings = ann.hashes(vectors, 4)
    query = ann.hashes(rnd.normal(size=(1, 16)), 4)[:, 0]
    longest = np.array([max(ann._common(strings[t, i], query[t]) for t in range(4)) for i in range(500)])
    for wanted in (1, 5, 60, 400, 500):
        got = forest.candidates(query, wanted)
        assert len(got) >= wanted
        cut = sorted(longest, reverse=True)[wanted - 1]
        assert wanted == 500 or set(got) == set(np.flatnonzero(longest >= cut))


def test_recall_without_structure_and_with_a_hot_group(spark):
    rnd = np.random.default_rng(4)
    plain = [(i, rnd.normal(size=64).tolist()) for i in range(1000)]
    hot = [(i, plain[1][1] if i % 3 == 1 else v) for i, v in plain]
    for rows in (plain, hot):
        want = {(q, i) for q, _, i, _ in brute(rows, set(range(0, 1000, 50)))}
        got = {(q, i) for q, _, i, _ in run(spark, rows)}
        assert len(got & want) >= 0.9 * len(want)


def test_equal_rows_count_once():
    vectors = np.random.default_rng(6).normal(size=(300, 16))
    vectors[:200] = vectors[0]
    forest, query = ann.Forest(np.arange(300), vectors), ann.hashes(vectors[:1], ann.TREES)[:, 0]
    assert forest.classes == 101 and len(forest.candidates(query, 50)) >= 200 + 49
