import random
from collections import defaultdict

import numpy as np

from quernstone.llm import line_align as la
from tests.llm.helpers import awkward, frame

WS = " \t\n\r\x0b\x0c"


def brute(rows):
    """Over all pairs of an earlier and a later document, and all runs of lines, with nothing of the operator's."""
    seqs = {i: [x.strip(WS) for x in (t or "").split("\n") if x.strip(WS)] for i, t in rows}
    words = lambda run: sum(len(x.encode().split()) for x in run)
    first = defaultdict(lambda: 1 << 60)
    runs = {}
    for i, s in seqs.items():
        runs[i] = [(a, b, tuple(s[a:b])) for a in range(len(s)) for b in range(a + 1, min(len(s), a + 12) + 1) if words(s[a:b]) >= 10]
        for _, _, run in runs[i]:
            first[run] = min(first[run], i)
    out = []
    for i, t in rows:
        gone = {k for a, b, run in runs[i] if first[run] < i for k in range(a, b)}
        kept, k = [], -1
        for x in (t or "").split("\n"):
            k += bool(x.strip(WS))
            if not (x.strip(WS) and k in gone):
                kept.append(x)
        out.append((i, len((t or "").split("\n")) if t else 0, len(gone), "\n".join(kept)))
    return sorted(out)


def pages(seed, n=60):
    r = random.Random(seed)
    say = lambda k: " ".join(f"w{r.randrange(50)}" for _ in range(k))
    pool = [say(r.randint(1, 14)) for _ in range(25)]
    rows = [(k, "\n".join(r.choice(pool) if r.random() < 0.5 else say(6) for _ in range(r.randint(0, 12))) + r.choice(["", "\n", "\n\n x"])) for k in range(n)]
    return rows + [(n + k, rows[5][1]) for k in range(5)]


def test_matches_brute_force(spark):
    for rows in (pages(1), pages(7, 120), awkward(2)):
        assert sorted(map(tuple, la.align_lines(frame(spark, rows)).collect())) == brute(rows)


def test_matches_brute_force_on_the_fixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, la.align_lines(docs).collect())) == brute(rows)


def test_all_pairs_of_patience_diffs_find_no_more():
    """Recall of the partners chosen: what aligning every pair would delete is deleted."""
    rows = pages(3, 50)
    seqs = {i: [x.strip(WS) for x in t.split("\n") if x.strip(WS)] for i, t in rows}
    words = {i: [len(x.split()) for x in s] for i, s in seqs.items()}
    every = {i: {k for j in seqs if j < i for k in la.common_blocks(seqs[i], seqs[j], words[i])} for i in seqs}
    assert sum(map(len, every.values())) > 20
    assert all(len(every[i]) <= n for i, _, n, _ in brute(rows))


def test_patience_is_a_common_subsequence():
    r = random.Random(0)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(12))] for _ in range(2))
        pairs = la.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert la.patience([1, 2, 3, 9, 4], [0, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 3), (4, 4)]


def test_moved_and_repeated_runs_go():
    n = np.full(6, 6)
    later, earlier = np.array([1, 2, 9, 3, 4, 8]), np.array([3, 4, 7, 1, 2, 5])
    assert la.lines_to_delete(later, earlier, n).tolist() == [0, 1, 3, 4]
    assert la.lines_to_delete(np.array([1, 1, 1, 1]), np.array([1, 1, 5]), np.full(4, 6)).tolist() == [0, 1, 2, 3]
    assert la.lines_to_delete(np.array([1, 2]), np.array([2, 1]), np.array([6, 6])).tolist() == []


def test_copies_go_and_null_ids_stay(spark):
    text = "one two three four five six\nseven eight nine ten eleven"
    got = la.align_lines(frame(spark, [(None, text), (2, text), (3, text), (3, text), (4, None)])).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.text) for r in got) == [("2", 0, text), ("3", 2, ""), ("3", 2, ""), ("4", 0, ""), ("None", 0, text)]
    assert la.align_lines(frame(spark, [])).collect() == []


def test_a_line_of_many_documents_goes_beside_a_rarer_one(spark):
    common, rare = (" ".join(f"{x}{k}" for k in range(12)) for x in "cr")
    rows = [(k, f"{common}\nown words of {k}") for k in range(80)] + [(90, f"{rare}\nown"), (91, f"{common}\n\n{rare}\nlast of all")]
    got = {r.doc_id: r.text for r in la.align_lines(frame(spark, rows)).collect()}
    assert got[0] == rows[0][1] and all(got[k] == f"own words of {k}" for k in range(1, 80))
    assert got[91] == "\nlast of all"


def test_a_block_of_short_lines_meets_its_first_occurrence(spark):
    a, b, c = "one two three four", "five six seven eight", "nine ten eleven"
    rows = [(1, f"{a}\nx"), (2, f"{b}\ny"), (3, f"{c}\nz"), (4, f"p\n{a}\n{b}\n{c}\nq"), (5, f"r\n{a}\n\n{b}\n{c}\ns")]
    got = {r.doc_id: r.text for r in la.align_lines(frame(spark, rows)).collect()}
    assert got == dict(rows[:4]) | {5: "r\n\ns"}


def test_short_lines_of_two_documents_that_copy_each_other(spark):
    one, two = "a b c d e f", "g h i j k l"
    rows = [(1, one), (2, two), (3, f"{one}\n{two}"), (4, f"{one}\n{two}")]
    assert {r.doc_id: r.text for r in la.align_lines(frame(spark, rows)).collect()} == dict(rows[:3]) | {4: ""}


def test_a_text_over_a_chunk(spark):
    long = "\n".join(f"line {k} of a very long text with quite a few words" for k in range(30000))
    rows = [(1, long), (2, "own line\n" + long[: len(long) // 2])]
    got = {r.doc_id: r for r in la.align_lines(frame(spark, rows)).collect()}
    assert len(long) > 1 << 20 and got[1].text == long and got[2].n_removed == 15102
