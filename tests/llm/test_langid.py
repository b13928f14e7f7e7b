import math
import zlib

import numpy as np

from palimpsest.llm import langid

SCHEMA = "doc_id long, lang string, text string, score double, lang_pred string"
EN = "the cat sat on the mat and the dog ate the bone near the old house by the river "
ES = "el gato se sienta en la alfombra y el perro come el hueso cerca de la casa vieja "


def slow_bits(text, tree, order):
    """Byte by byte, from the text alone."""
    total = 0.0
    for i, b in enumerate(text):
        context = text[max(0, i - order) : i]
        while context not in tree:
            context = context[1:]
        out = set()
        while True:
            counts = {int(c): int(n) for c, n in zip(*tree[context], strict=True) if int(c) not in out}
            base = sum(counts.values()) + (len(counts) if len(counts) < 256 - len(out) else 0)
            if b in counts:
                total += math.log2(base / counts[b])
                break
            if counts:
                total += math.log2(base / len(counts))
                out |= set(counts)
            if not context:
                total += math.log2(256 - len(out))
                break
            context = context[1:]
    return total


def test_score_is_that_of_plain_ppm(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 7)
    samples = {"en": [EN.encode() * 2], "es": [ES.encode() * 2]}
    model = langid.Model(samples, order=3, contexts=60)
    texts = [b"the dog", "él año de la casa ÿ".encode(), b"x", (EN + ES).encode(), b"\x00\xff" * 9]
    got = model.score(texts)
    for k, lang in enumerate(model.langs):
        tree = langid._tree(samples[lang], 3, 60)
        assert len(tree) <= 60
        np.testing.assert_allclose(got[:, k], [slow_bits(t, tree, 3) for t in texts], rtol=1e-4)


def test_costs_are_a_code():
    model = langid.Model({"en": [EN.encode()]}, order=3, contexts=50)
    np.testing.assert_allclose(np.exp2(-model.cost.reshape(-1, 256).astype(float)).sum(axis=1), 1, rtol=1e-4)


def rows():
    out = [(i, "en" if i % 2 else "es", (EN if i % 2 else ES)[i % 20 :] + str(i), 0.0, "z") for i in range(60)]
    return [*out, (90, None, EN, 0.0, "z"), (91, "en", None, 0.0, "z"), (92, "en", "", 0.0, "z"), (93, "es", "123 !!", 0.0, "z"), (None, "es", ES * 900, 0.0, "z"), (3, "en", EN, 0.0, "z"), (3, "en", EN, 0.0, "z")]


def test_predict(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (91, 92, 93)} == {"und"} and by[91].score == 0
    assert by[90].lang_pred == "en" and by[None].lang_pred == "es"
    assert all(by[i].lang_pred == ("en" if i % 2 else "es") and 0 <= by[i].score <= 1 for i in range(60))
    held = docs.select("doc_id", (~langid.in_training("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held if r.doc_id is not None)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, None, EN, 0.0, "z")], SCHEMA)
    assert [r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()] == ["und"]
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


def test_learns_from_the_training_part_only(spark):
    docs = spark.createDataFrame([(i, "en", EN, 0.0, "z") for i in range(40)] + [(i, "xx", ES, 0.0, "z") for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2], SCHEMA)
    assert langid.fit(docs).langs == ["en"]


def test_rich_text_keeps_its_contexts():
    import random

    rnd = random.Random(8)
    text = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(10_000)).encode()
    tree = langid._tree([text], langid.ORDER, langid.CONTEXTS)
    assert 5_000 < len(tree) <= 6_001


def test_sample_is_of_the_least_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    texts = [(i, None if i % 11 == 0 else "x" * (i % 7 * 5_000), ("en", "de", None)[i % 3]) for i in range(400)]
    docs = spark.createDataFrame([*texts, *texts[:50]], "doc_id long, text string, lang string").repartition(3)
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 9)
    monkeypatch.setattr(langid, "Model", lambda samples: samples)
    rows = docs.filter(langid.in_training("doc_id") & F.octet_length("text").between(1, langid.SAMPLE_BYTES)).select("lang", F.xxhash64("doc_id", "text").alias("h"), "text").distinct().collect()
    want = {x: [r.text.encode() for r in sorted((r for r in rows if r.lang == x), key=lambda r: r.h)[:9]] for x in ("en", "de")}
    for spare in (1.2, 8, 1000):
        monkeypatch.setattr(langid, "SPARE", spare)
        assert langid.fit(docs) == want
