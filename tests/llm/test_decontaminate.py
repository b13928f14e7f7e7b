import pytest
import hashlib
import random
import re

from palimpsest.llm import decontaminate as d

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items, window):
    ws = W.findall((text or "").translate(LOW))
    hit, found = set(), set()
    for name, item in items:
        iw = W.findall((item or "").translate(LOW))
        k = min(window, len(iw))
        wins = {tuple(iw[p : p + k]) for p in range(len(iw) - k + 1)} if k else set()
        for p in range(len(ws) - k + 1):
            if k and tuple(ws[p : p + k]) in wins:
                hit |= set(range(p, p + k))
                found.add(name)
    return len(ws), hit, sorted(found)


def test_automaton_against_brute_force():
    rnd = random.Random(5)
    for _ in range(400):
        letters = "abC" if rnd.random() < 0.7 else "abcdé"
        text = lambda n: "".join(rnd.choice(letters) + rnd.choice([" ", "-", "\n"]) for _ in range(rnd.randint(0, n)))  # noqa: B023, E731
        items = [(str(i), text(9)) for i in range(rnd.randint(0, 5))] + [("n", None)]
        window, doc = rnd.randint(1, 5), text(60)
        n, hit, _, found = d.scan_text(doc.encode(), d.automata([(a, b and b.encode()) for a, b in items], window))
        want = brute(doc, items, window)
        assert (n, {i for i, h in enumerate(hit) if h}, found) == want
        left = W.findall(d.remove_spans(doc, hit).translate(LOW))
        assert len(left) == n - len(want[1])


def test_blocks_of_items(monkeypatch):
    monkeypatch.setattr(d, "BLOCK_WORDS", 3)
    autos = d.automata([("a", b"x y"), ("b", b"y z w"), ("c", b"x y z")], 2)
    assert len(autos) > 1 and d.scan_text(b"x y z", autos)[2:] == (3, ["a", "b", "c"])


def test_query_on_odd_rows(spark):
    bench = spark.createDataFrame([(10, "One two THREE", 1), (9, "one two three", 1), (8, "", 1), (7, None, 1), (6, " ".join(f"w{i}" for i in range(12)), 1)], "item_id long, text string, n_words int")
    long = "pad " * 50_000 + "one, two - three"
    rows = [(1, None, 0), (2, "", 0), (3, "zero one two three four", 0), (3, "zero one two three four", 0), (4, long, 0), (None, "W1 w2 w3 w4 w5 w6 w7 w8 w9 w10 end", 0), (5, "...", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit int")
    got = d.decontaminate(docs, bench).collect()
    by = {r.doc_id: r for r in got}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == 7
    assert (by[3].n_words, by[3].n_hit, by[3].n_items, by[3].items_sha256, by[3].clean_text) == (5, 3, 2, sha("10,9"), "zero  four")
    assert by[3].drop and not by[4].drop and by[4].n_hit == 3 and by[4].clean_text == "pad " * 50_000
    assert by[None].n_hit == 10 and by[None].items_sha256 == sha("6")
    assert [(by[i].n_words, by[i].contaminated, by[i].items_sha256) for i in (1, 2, 5)] == [(0, False, sha(""))] * 3
    assert d.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert d.decontaminate(docs.limit(0), bench).count() == 0


def test_items_without_an_id_and_the_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "say one two three now"), (None, "four five"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three"), (None, "four five"), ("b", "two three"), ("c", None)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in d.decontaminate(docs, items).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (3, 2, digest("b")), None: (2, 1, digest("")), 2: (0, 0, digest(""))}
    monkeypatch.setattr(d, "BENCHMARK_BYTES", 5)
    with pytest.raises(ValueError, match="in parts"):
        d.decontaminate(docs, items)

