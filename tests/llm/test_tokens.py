import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import dac, packing, tokens

SCHEMA = "doc_id long, text string, n_tokens long, start string"


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.default_path())


def whole(enc, text):
    return enc.lib.encode(text, add_special_tokens=False).ids


ALPHABET = "aAéÉßıİ̈ǅſ 09²½,.!%$#*'’“-_<|>stmdlrve\n\t\x1c\x85\xa0 漢ก😀"


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=30) | st.text(max_size=30))
def test_encode_is_that_of_the_library(text):
    enc = tokens.encoder(tokens.default_path())
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == whole(enc, text)


def test_special_tokens_and_generations(enc, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 3)
    text = "a <|endoftext|> b<|startoftext|>c one, two. three% don't can't! 'twas Été," * 3
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == whole(enc, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), max_size=6))
def test_segment_round_trip_and_random_access(docs):
    flat = np.array([x for d in docs for x in d], dtype=np.uint32)
    seg = dac.Segment(dac.write_segment([None if i == 1 else i - 3 for i in range(len(docs))], [len(d) for d in docs], flat))
    assert seg.doc_ids == [None if i == 1 else i - 3 for i in range(len(docs))]
    assert [seg.document(k).tolist() for k in range(len(docs))] == docs
    for i in random.Random(1).sample(range(len(flat)), min(20, len(flat))):
        assert seg.token(i) == flat[i]


ROWS = [(5, "The cat", 1, "x"), (None, "no id", 1, "x"), (2, None, 1, "x"), (9, "", 1, "x"), (5, "The cat", 1, "x"), (7, "word " * 30_000, 1, "x"), (-3, "É’t!", 1, "x")]


def test_token_files(spark, enc, tmp_path, monkeypatch):
    monkeypatch.setattr(dac, "SEGMENT_TOKENS", 3)
    files = dac.write(spark.createDataFrame(ROWS, SCHEMA).repartition(3))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in dac.read(files).collect())
    at, want = 0, []
    for doc_id, text, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole(enc, text or ""), tokens.END_ID]
        want.append((at, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    names = dac.export_segments(files, str(tmp_path))
    assert [d for n in names for d in dac.Segment(open(n, "rb").read()).doc_ids] == [w[1] for w in want]
    assert dac.read(dac.write(spark.createDataFrame([], SCHEMA))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 5))
def test_boundaries_are_optimal(hist, k):
    from itertools import combinations

    lens = sorted(hist)
    pad = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in hist.items())
    best = min(pad([*c, lens[-1]]) for r in range(min(k, len(lens))) for c in combinations(lens[:-1], r))
    ends = packing.boundaries(np.array(lens), np.array([hist[n] for n in lens]), k)
    assert len(ends) <= k and ends == sorted(set(ends)) and pad(ends) == best


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 7)
    rows = [(i % 50, None, i % 13 + 1 if i % 40 else 900, "x") for i in range(200)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), buckets=4, budget=60).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((a, c) for a, _, c, _ in rows)
    batches = {}
    for r in got:
        assert r.padding == r.bucket_tokens - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), rs in batches.items():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert len(rs) == 1 or len(rs) * rs[0].bucket_tokens <= 60
        last = max(b for k, b in batches if k == bucket)
        assert batch == last or (len(rs) + 1) * rs[0].bucket_tokens > 60
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_token_counts(spark, enc):
    got = packing.token_counts(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(whole(enc, r[1] or "")) + 1 for r in ROWS)
