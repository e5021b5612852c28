import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quernstone.llm import language_model as lm
from tests.llm.helpers import awkward, frame


def tokens(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "<end>"]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def brute(rows):
    c = Counter(t for i, text in rows if not held_out(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for i, text in rows:
        own = tokens(text)
        out.append((str(i), held_out(i), len(own), sum(c[t] > 0 for t in own), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)))
    return sorted(out)


def test_base_matches_brute_force(spark):
    rows = awkward(1) + [(None, "no id"), (3, "again")]
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score_documents(frame(spark, rows)).collect())
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    assert lm.score_documents(frame(spark, [])).collect() == []


@pytest.mark.parametrize("size", ["0.001", "0.01", "0.1"])
def test_better_than_the_base_on_held_out_documents(spark, size):
    rows = lm.op5_recurrent_lm(spark, f"/root/testdata/sf{size}").filter("held_out").collect()
    assert sum(r.score for r in rows) > 0.985 * sum(r.base_score for r in rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_scores_do_not_depend_on_partitions(spark, sf, monkeypatch):
    monkeypatch.setattr(lm.bk, "buckets_for", lambda docs: 20)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one, other = ({r.doc_id: r.score for r in lm.score_documents(d).collect()} for d in (docs.coalesce(1), docs.repartition(7, "text")))
    assert one == other


def small_model(seed=0):
    m = lm.Model(np.arange(1, 12, dtype=np.uint64) * np.uint64(977), np.arange(11, 0, -1), hidden=5, classes=3)
    r = np.random.default_rng(seed)
    return m, r.normal(0, 0.5, len(m.flat)).astype(np.float32)


def test_probabilities_sum_to_one():
    m, flat = small_model()
    states = np.random.default_rng(1).normal(size=(1, m.h)).astype(np.float32)
    lp, _ = lm.log_probs(m, m.views(flat), np.repeat(states, m.n, 0), np.arange(m.n))
    assert abs(np.exp(lp).sum() - 1) < 1e-5


def test_state_is_carried_to_the_end_of_each_document_alone():
    m, flat = small_model()
    r = np.random.default_rng(2)
    lengths = np.array([70, 1, 33, 5, 100])
    ptr = np.append(0, np.cumsum(lengths))
    words = r.integers(0, m.n, ptr[-1]).astype(np.int32)
    together = lm.run(m, flat.copy(), words, ptr)
    for a, b in zip(ptr[:-1], ptr[1:]):
        h, w = np.zeros((1, m.h), np.float32), m.views(flat)
        for k in range(a, b):
            lp, _ = lm.log_probs(m, w, h, words[k : k + 1])
            assert abs(lp[0] - together[k]) < 1e-4
            _, h, _ = lm.forward(w, words[k : k + 1][None], h, np.ones((1, 1), np.float32), False)


def test_gradients():
    m, flat = small_model()
    m.flat = flat = flat.astype(np.float64)
    lm_f, lm._f = lm._f, np.float64
    try:
        r = np.random.default_rng(3)
        x, h = r.integers(0, m.n, (4, 3)), r.normal(size=(3, m.h))
        live = np.ones((4, 3))
        live[1, 2] = 0

        def loss(f):
            states, _, _ = lm.forward(m.views(f), x, h, live, False)
            return -lm.log_probs(m, m.views(f), states.reshape(-1, m.h), x.ravel())[0].sum()

        w, g = m.views(flat), np.zeros_like(flat)
        states, _, saved = lm.forward(w, x, h, live, True)
        _, back = lm.log_probs(m, w, states.reshape(-1, m.h), x.ravel(), m.views(g))
        lm.backward(w, x, states, saved, live, back.reshape(states.shape), m.views(g))
        for k in r.choice(len(flat), 60, replace=False):
            d = np.zeros_like(flat)
            d[k] = 1e-5
            assert abs((loss(flat + d) - loss(flat - d)) / 2e-5 - g[k]) < 1e-4
    finally:
        lm._f = lm_f
