import random

import corpus_pipeline as p
import test_jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_of_each(spark):
    rows = test_jaccard.corpus(7, groups=6)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)
    kept = p.near_copies(spark, docs, "").collect()
    groups = test_jaccard.brute(rows)
    filled = [r for r in kept if test_jaccard.shingle_set(r.text)]
    assert len(kept) - len(filled) == sum(1 for _, n, _ in groups if n == 0)
    assert sorted(r.doc_id for r in filled if r.doc_id is not None) == sorted({c for _, n, c in groups if n and c is not None})
    # what is left has no links any more
    assert len({c for _, _, c in test_jaccard.brute([(i, r.text) for i, r in enumerate(filled)])}) == len(filled)


def test_run(spark, tmp_path):
    rnd = random.Random(1)
    en, es = "the of and to in is that for with his from they were which".split(), "el de que y en los se por con para una sus como más".split()
    text = lambda ws, n: " ".join(rnd.choice(ws) + (f"{rnd.choice('abcdefgh')}ing" if rnd.random() < 0.3 else "") for _ in range(n))
    rows = [(i, text(en if i % 2 else es, 60 + i), "en" if i % 2 else "es", "s") for i in range(40)]
    rows += [(100 + i, rows[1][1], "en", "s") for i in range(30)] + [(200, rows[2][1] + " more", "es", "s")]
    item = " ".join(f"quiz{i}" for i in range(12))
    rows += [(300, text(en, 80) + " " + item + " " + text(en, 50), "en", "s"), (301, item, "en", "s"), (302, "12 34 !!", "en", "s"), (303, None, None, None), (304, text(en, 90) + " bob@corp.org", "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    step, seen = docs, []
    for name, f in p.STAGES[:-1]:
        step = f(spark, step, str(tmp_path))
        assert step.columns == docs.columns and [x[1] for x in step.dtypes] == [x[1] for x in docs.dtypes]
        step = p.stage(step, "test")
        seen.append({r.doc_id: r for r in step.collect()})
    assert set(seen[0]) == {r[0] for r in rows} - {302, 303}
    assert set(seen[1]) == set(range(40)) | {300, 301, 304}
    assert set(seen[2]) == set(seen[1]) - {301} and "quiz" not in seen[2][300].text and seen[2][1].text == rows[1][1]
    assert seen[2][300].n_chars == len(seen[2][300].text)
    assert set(seen[3]) == set(seen[2]) and seen[3][304].text.endswith(" [EMAIL]") and seen[3][1].text == rows[1][1]
    out = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(seen[3]) and all(r.padding >= 0 for r in out)


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    en = "the of and to in is that for with his from they were which " * 6
    rows = [(1, en + "a@b.org", "en", 1.0, 2, "x", "y"), (2, en + "one two three four", "en", None, None, None, None), (None, None, None, 1.0, 1, "z", "z"), (1, en + "a@b.org", "en", 1.0, 2, "x", "y")]
    docs = spark.createDataFrame([(d, t, k, len(t or ""), *more) for d, t, k, *more in rows], "doc_id long, text string, lang string, n_chars long, score double, n_hit long, __hash string, __own string")
    spark.createDataFrame([("i", "one two three four")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table, want in ((docs, [1, 1, 2]), (docs.limit(0), [])):
        step = table
        for n, (name, f) in enumerate(p.STAGES[:-1]):
            step = p.stage(f(spark, step, str(tmp_path)), "test")
            assert step.dtypes == table.dtypes, name
            if n == 0:
                assert sorted(r.doc_id for r in step.collect()) == want
        assert step.filter("text like '%@%' or text like '%three%'").count() == 0
        out = p.packed(spark, step, str(tmp_path)).collect()
        assert len(out) == step.count() == len(set(want))

