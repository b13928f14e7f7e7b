import hashlib
import random

import pytest

from palimpsest.llm import suffix_dedup as s

SCHEMA = "doc_id long, text string, n_bytes long, h1 string, data string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen, out = {}, []
    for d in data:
        for p in range(len(d) - length + 1):
            seen[d[p : p + length]] = seen.get(d[p : p + length], 0) + 1
    for d in data:
        hit = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                hit[p : p + length] = b"\x01" * length
        kept = bytes(c for c, x in zip(d, hit, strict=True) if not x)
        spans = sum(1 for i, x in enumerate(hit) if x and (not i or not hit[i - 1]))
        out.append((len(d), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rnd.randint(75, 120)) for _ in range(6)]
    out = [None, "", "short", "a" * 399, "a" * 400, "b" * 1000, "xy" * 700, " " * 450 + text(9)]
    for _ in range(30):
        parts = [text(rnd.randint(0, 90))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a, b = sorted((rnd.randint(0, 60), rnd.randint(0, len(p))))
            parts += [p[a:] if rnd.random() < 0.5 else p[: len(p) - a], text(rnd.randint(0, 40))]
        out.append(" ".join(parts))
    base = text(260)
    for _ in range(8):  # near copies
        c = list(base)
        for _ in range(rnd.randint(0, 3)):
            c[rnd.randrange(len(c))] = "#"
        out.append("".join(c))
    edge = text(200).encode().decode()[:430]
    out += [edge[:k] + "!" + text(20) for k in (398, 399, 400, 401, 405, 430)] + ["!" + edge[k:] for k in (0, 1, 29, 30, 31)]
    out += [out[9], out[9], text(4000)]
    return out


def run(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.dedup(docs, **options).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    assert run(spark, texts) == brute(texts, 400)


def test_planted_passages_count_by_their_bytes(spark):
    rnd = random.Random(6)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(n))
    texts, want = [], []
    for size in (260, 399, 400, 401, 800):
        passage = text(size)[:size]
        assert len(passage.split()) > 50
        # Between bytes that differ, so that no more than the passage repeats.
        texts += [text(40) + "<" + passage + ">" + text(90), text(300) + "[" + passage + "]", "(" + passage + ")" + text(5), text(200)]
        want += [size if size >= 400 else 0] * 3 + [0]
    got = run(spark, texts)
    assert [r[1] for r in got] == want
    assert got == brute(texts, 400)


def test_hot_classes_and_small_queues(spark, monkeypatch):
    monkeypatch.setattr(s, "HOT", 2)
    monkeypatch.setattr(s, "RUN", 3)
    monkeypatch.setattr(s, "BROADCAST_ROWS", 1)
    texts = corpus(3)
    assert run(spark, texts) == brute(texts, 400)


def test_anchors_depend_on_the_string_alone():
    rnd = random.Random(4)
    core = bytes(rnd.choice(b"abc") for _ in range(600))
    one, two = b"zz" + core + b"q" * 300, bytes(rnd.choice(b"xyz") for _ in range(911)) + core + b"r"
    of = lambda d: {p: a - p for a, x, y in zip(*(v.tolist() for v in s.anchors(d)), strict=True) for p in range(x, y + 1)}
    a, b = of(one), of(two)
    assert sorted(a) == list(range(len(one) - 399)) and sorted(b) == list(range(len(two) - 399))
    assert all(a[2 + p] == b[911 + p] for p in range(201))


def test_induce_against_brute_force():
    rnd = random.Random(5)
    for _ in range(400):
        width = rnd.choice([1, 2, 4, 8])
        rows = [(rnd.choice([b"D", b"E"]), bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(0, width - 1))), bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(0, width - 1)))) for _ in range(rnd.randint(0, 12))]
        rows.sort(key=lambda r: (r[0], r[2], r[1]))
        strings = [[(d, b[len(b) - k :], a[: width - 1 - k]) if len(b) >= k and len(a) >= width - 1 - k else None for k in range(width)] for d, b, a in rows]
        want = [[x is not None and sum(o[k] == x for o in strings) > 1 for k, x in enumerate(own)] for own in strings]
        assert s.induce([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], width).tolist() == want


def test_disk_queue():
    queue = s.DiskQueue(3)
    items = [(random.Random(i).randrange(50), i) for i in range(100)]
    for x in items:
        queue.push(x)
    assert len(queue.files) == 33 and list(queue) == sorted(items)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, ["ab" * 10, None]) == brute(["ab" * 10, None], 400)
