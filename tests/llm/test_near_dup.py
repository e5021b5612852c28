import random
import re

import numpy as np
import pytest

from quernstone.llm import near_dup as nd
from quernstone.llm.components import connected_components
from tests.llm.helpers import awkward, frame


def shingles(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x]:
                both = len(sets[x] & sets[y])
                if both and 100 * both >= 75 * len(sets[x] | sets[y]):
                    a, b = top(x), top(y)
                    parent[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), top(i), top(i) == i) for i in ids)


def family(seed, n=90, words=150, edits=25):
    """Near copies of one text with few to many edits: some linked, some not, all sharing sketch values."""
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(words)] = f"e{k}x{r.randrange(9)}"
        out.append((1000 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("rows", [awkward(1), awkward(2), family(3), family(4, 60, 60, 10) + awkward(5, 10)], ids=["a", "b", "family", "mixed"])
def test_matches_brute_force(spark, rows):
    assert sorted(map(tuple, nd.near_duplicates(frame(spark, rows)).collect())) == brute(rows)


def test_blocks_alone_find_all(spark, monkeypatch):
    monkeypatch.setattr(nd, "PIVOT_ROUNDS", 1)
    monkeypatch.setattr(nd, "BLOCK", 700)
    rows = family(6, 70)
    assert sorted(map(tuple, nd.near_duplicates(frame(spark, rows)).collect())) == brute(rows)


def test_null_ids_repeats_and_empty(spark):
    got = nd.near_duplicates(frame(spark, [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got) == [("1", 2, 1, True), ("1", 2, 1, True), ("None", 0, None, True), ("None", 2, None, True)]
    assert nd.near_duplicates(frame(spark, [])).collect() == []


def test_repeated_ids_are_one_vertex(spark):
    t1, t2 = ("a b c d e f g h", "p q r s t u v w")
    rows = [(5, t1), (5, t2), (3, t1), (4, t2), (9, t2), (5, None), (7, "x y z a b c"), (7, "k l m n o p"), (8, "K l m n o p")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(frame(spark, rows)).collect())
    assert got == [(3, 3, True), (4, 3, False), (5, 3, False), (5, 3, False), (5, 3, False), (7, 7, True), (7, 7, True), (8, 7, False), (9, 3, False)]


def test_whole_sets_retained(spark):
    rows = family(8, 40)
    assert sorted(map(tuple, nd.near_duplicates(frame(spark, rows), sketch=None).collect())) == brute(rows)


def test_intersections():
    r = np.random.default_rng(0)
    a, b = ([np.unique(r.choice(300, r.integers(1, 90))).astype(np.uint64) for _ in range(n)] for n in (40, 31))
    a = [np.union1d(x, [np.uint64(9999)]) for x in a]
    b = [np.union1d(x, [np.uint64(9999)]) for x in b]
    assert (nd.intersections(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_notices_that_differ_in_a_word(spark):
    """Many short texts, each pair just under the threshold: no quadratic work, and links where they are."""
    rows = [(k, f"this very short notice was sent to member number{k}") for k in range(3000)]
    rows += [(5000 + k, f"this very short notice was sent to member number{k} again today so that they see it at last once more") for k in range(0, 60, 2)]
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(frame(spark, rows)).collect()}
    assert [i for i, c in got.items() if i != c] == []


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
