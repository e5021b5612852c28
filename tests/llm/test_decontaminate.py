import random
import re

import numpy as np
import pytest

from quernstone.llm import decontaminate as dc
from tests.llm.helpers import awkward, frame


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def case(seed):
    r = random.Random(seed)
    vocab = [f"v{k}" for k in range(25)] + ["Äh", "x9"]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    items = [(k, say(r.randint(14, 30))) for k in range(8)] + [(50, "v1 v2 v3"), (51, ""), (52, None), (53, "v1, V2; v3")]
    docs = [(k, f"{say(r.randint(0, 60))} {r.choice(items)[1] or ''}. {say(r.randint(0, 9))}") for k in range(60)]
    return docs + [(100 + i, t) for i, t in awkward(seed, 10)] + [(None, items[0][1]), (None, None), (1, items[1][1])], items


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    docs, items = case(block)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.find_contamination(frame(spark, docs), bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in got), key=str) == brute(docs, items)


def test_removal_and_whole_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = frame(spark, [(1, "One, Alpha beta; GAMMA delta! two"), (2, " ".join(f"w{k}" for k in range(90)) + " alpha beta gamma delta")])
    found = dc.find_contamination(docs, bench)
    assert {r.doc_id: r.text for r in dc.remove_spans(found).collect()}[1] == "One, ! two"
    assert [r.doc_id for r in dc.keep_rows(docs, bench).collect()] == [2]
    assert dc.keep_rows(docs, bench).columns == docs.columns
    assert all(not r.contaminated for r in dc.find_contamination(docs, bench.limit(0)).collect())
    assert dc.find_contamination(frame(spark, []), bench).collect() == []


def test_fm_index_finds_all_places():
    r = np.random.default_rng(0)
    text = np.append(r.integers(1, 5, 500), 0)
    index = dc.FMIndex(text, 4)
    for n in (1, 2, 4):
        phrases = r.integers(1, 5, (30, n))
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi):
            want = [k for k in range(len(text) - n) if (text[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
