import random

import numpy as np
import pytest

from quernstone.llm import repetition as rp
from tests.llm.helpers import awkward, frame


def brute(text):
    text = text or ""
    words = text.encode().split()
    n = len(words)
    grams = {}
    for k in range(n - 4):
        grams.setdefault(tuple(words[k : k + 5]), []).append(k)
    hit = {k + j for at in grams.values() if len(at) > 1 for k in at for j in range(5)}
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    longest = 0
    for a in range(n):
        for b in range(a):
            k = 0
            while a + k < n and words[a + k] == words[b + k]:
                k += 1
            longest = max(longest, k)
    longest = longest if longest >= 5 else 0
    covered = set()
    for a in range(n):
        for b in range(a):
            k = 0
            while a + k < n and words[a + k] == words[b + k]:
                k += 1
            if k >= rp.MIN_WORDS:
                covered |= {*range(a, a + k), *range(b, b + k)}
    chars = [len(w.decode()) for w in words]
    failed = n < 10 or 100 * len(hit) > 20 * n
    kept = not failed and sum(chars[k] for k in covered) <= rp.MAX_COVERED * sum(chars) and longest <= rp.MAX_LONGEST
    return n, sum(chars), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed, sum(chars[k] for k in covered), longest, kept


def rows(seed):
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice("abcdefgh") + r.choice("uvwxyz|%é") for _ in range(k))
    out = []
    for k in range(40):
        p = say(r.randint(5, 20))
        out.append((100 + k, "\n".join(r.choice([p, p, say(r.randint(1, 30))]) for _ in range(r.randint(1, 6)))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    data = [(i, t if t is None or len(t) < 3000 else t[:600]) for i, t in awkward(seed, 20) + rows(seed)] + [(None, "a b c"), (None, None), (1, "again again")]
    got = rp.repetition_rules(frame(spark, data)).drop("n_maximal").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *brute(t))) for i, t in data)


def test_maximal_repeats_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(12)) + " x " + " ".join(f"w{k}" for k in range(12)) + " " + " ".join(f"u{k}" for k in range(80))
    (r,) = rp.repetition_rules(frame(spark, [(1, text)])).collect()
    assert (r.n_maximal, r.longest_repeat, r.n_repeat_words, r.base_failed) == (2, 12, 24, True)
    assert rp.repetition_rules(frame(spark, [])).collect() == []
    assert rp.keep_rows(frame(spark, [(1, text), (2, " ".join(f"u{k}" for k in range(80)))])).collect()[0].doc_id == 2


def test_suffix_order():
    r = np.random.default_rng(0)
    for high in (2, 3, 50):
        x = r.integers(0, high, 300)
        assert rp.suffix_order(x).tolist() == sorted(range(300), key=lambda k: x[k:].tolist())
