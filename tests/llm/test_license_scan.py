import random
import re

import pytest

from quernstone.llm import license_scan as ls
from tests.llm.helpers import awkward, frame


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def shingles(w):
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute(text):
    """Licenses of which some window of W shingles holds 0.75 of a template."""
    w, out = words(text), set()
    for name, versions in ls.TEMPLATES.items():
        for t in versions:
            want = shingles(words(t))
            m = len(words(t)) - 4
            for k in range(max(0, len(w) - 4)):
                if len(shingles(w[k : k + m + 4]) & want) >= 0.75 * len(want):
                    out.add(name)
    return out


def planted(seed):
    r = random.Random(seed)
    say = lambda k: " ".join("".join(r.choice("abcde") for _ in range(4)) for _ in range(k))
    rows = []
    for k in range(60):
        text = say(r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            t = r.choice([v for vs in ls.TEMPLATES.values() for v in vs]).split()
            if len(t) > 20:
                t[r.randrange(len(t))] = "changed"
            text += r.choice([" ", "\n", " * "]) + r.choice([" ", "\n  "]).join(t) + ".\n" + say(r.randint(0, 30))
        rows.append((k, text.upper() if k % 7 == 0 else text))
    return rows


def test_finds_what_brute_force_finds(spark):
    rows = planted(1) + [(100 + i, t) for i, t in awkward(1)] + [(None, "Released under the MIT License."), (None, None)]
    got = {(r.doc_id): {m.license for m in r.matches} for r in ls.scan_licenses(frame(spark, rows)).collect()}
    assert {i: s for i, s in got.items() if i is not None} == {i: brute(t) for i, t in rows if i is not None}


def test_spans_cover_the_notice(spark):
    text = "é before\nReleased under the MIT License. after"
    (row,) = ls.scan_licenses(frame(spark, [(1, text)])).collect()
    (m,) = row.matches
    assert (m.license, m.containment) == ("MIT", 1.0)
    assert text.encode()[m.start : m.end] == b"Released under the MIT License"


def test_empty_and_short_templates(spark):
    assert ls.scan_licenses(frame(spark, [])).collect() == []
    assert ls.scan_licenses(frame(spark, [(1, "a b c d e f")]), {}).collect()[0].matches == []
    with pytest.raises(ValueError):
        ls.scan_licenses(frame(spark, [(1, "a")]), {"X": ["too short"]})
