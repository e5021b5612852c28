"""Small documents with the awkward cases, and a frame of them."""

import random

SCHEMA = "rep string, doc_id long, text string, kept int, component_id string"


def frame(spark, rows):
    """``rows``: (doc_id, text); the other columns clash with names the operators use."""
    return spark.createDataFrame([("x", i, t, 7, None) for i, t in rows], SCHEMA).repartition(3)


def awkward(seed=0, n=40):
    """Ids and texts: nulls, empties, copies, near copies, shared passages, odd spaces, long words."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeßñ") for _ in range(r.randint(1, 7))) for _ in range(60)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, base = say(40), say(120)
    rows = [(0, None), (1, ""), (2, "one"), (3, "Two words"), (4, "  \n\t "), (5, base), (6, base), (7, base + " tail"), (8, "x" * 5000), (9, "na " * 300), (10, "x" * 5000)]
    for k in range(n):
        kind = r.randrange(5)
        if kind == 0:
            words = base.split(" ")
            words[r.randrange(len(words))] = r.choice(vocab)
            rows.append((11 + k, " ".join(words)))
        elif kind == 1:
            rows.append((11 + k, say(30) + "\n" + passage + "\n" + say(r.randint(0, 50))))
        elif kind == 2:
            rows.append((11 + k, r.choice(rows)[1]))
        else:
            rows.append((11 + k, say(r.randint(1, 90)) + r.choice(["", "\x0b", "\r\n", " É "]) + say(5)))
    return rows
