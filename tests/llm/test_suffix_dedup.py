import hashlib
import random

import numpy as np
import pytest

from quernstone.llm import suffix_dedup as sd
from tests.llm.helpers import awkward, frame


def brute(rows):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for k in range(len(t) - 49):
            w = t[k : k + 50]
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if i is not None and first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = awkward(seed) + [(None, "x" * 5000), (6, "y" * 80), (6, "y" * 80)]
    got = sd.remove_repeats(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sd.bk, "buckets_for", lambda *_: 7)
    rows = awkward(3, 80) + [(None, "x" * 5000), (6, "y" * 80), (6, "y" * 80)]
    got = sd.remove_repeats(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_a_text_over_a_chunk(spark):
    long = "".join(f"word{k} " for k in range(150000))
    rows = [(1, long[5000:9000]), (2, long), (3, "own " + long[600000:700000] + " own")]
    assert len(long) > 1 << 20
    got = sd.remove_repeats(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_documents_of_the_fixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, sd.op4_deep_shallow(spark, sf).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert sd.remove_repeats(frame(spark, [])).collect() == []


def test_deep_shallow_order():
    r = random.Random(3)
    base = bytes(r.choice(b"ab") for _ in range(70))
    text = b"".join(base[: r.randint(30, 70)] + bytes([r.choice(b"abc")]) for _ in range(60)) + b"z" * 50
    starts = np.arange(len(text) - 50)
    order, cls = sd.deep_shallow(np.frombuffer(text, np.uint8), starts)
    strings = [text[starts[k] : starts[k] + 50] for k in order]
    assert strings == sorted(strings)
    assert sorted(order.tolist()) == starts.tolist()
    assert cls.tolist() == [sorted(set(strings)).index(s) for s in strings]
