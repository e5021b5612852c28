import hashlib
import random
import re

from quernstone.llm import pii
from tests.llm.helpers import awkward, frame

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return sum(d[0::2] + [2 * x - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def noisy(seed):
    r = random.Random(seed)
    bits = ["4111 1111 1111 1111", "5500-0000-0000-0004", "1.2.3.4", "256.1.1.1", "10.0.0.1.7", "a@b.co", "x.y+z@mail-1.example.com.", "a@b_c@d.e", "@", "+1 (555) 123-4567", "+44 20 7946 0958 ", "+12", "é", "😀", " ", "12", "-", ".", "\n", "007.08.9.255", "a@b.c_d@e.f", "%", "word", "9" * 25]
    return [(k, "".join(r.choice(bits) + r.choice(["", " ", ""]) for _ in range(r.randint(0, 25)))) for k in range(150)]


def test_base_matches_brute_force(spark):
    rows = noisy(1) + [(200 + i, t) for i, t in awkward(1)] + [(None, "a@b.co"), (None, None), (300, "1" * 20000), (301, "x" * 50000 + "@"), (302, "1 " * 5000), (303, "a@b" + ".c" * 9000)]
    got = sorted(((str(r.doc_id), [tuple(s) for s in r.base]) for r in pii.find_pii(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((str(i), brute(t or "")) for i, t in rows), key=str)


def test_digest_of_the_fixture(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op3_contextual_pii(spark, sf).collect():
        spans = brute(texts[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_contexts_discover_new_identifiers(spark):
    rows = [(k, f"some words contact: user{k}@mail.example.com and more") for k in range(20)]
    rows += [(50, "write to contact: agent_007x today"), (51, "the year 19999 was good"), (52, "see page 12345 there")]
    rows += [(60 + k, f"see page {10000 + k} there") for k in range(10)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_pii(frame(spark, rows)).collect()}
    assert got[50] == [(18, 4, 28)]
    assert got[51] == [] and got[52] == []


def test_spans_of_several_tokens_and_prefixes_are_seeds(spark):
    rows = [(k, f"to reach us dial +1 (555) {100 + k}-4567 or mailto:u{k}@x.example at night") for k in range(20)]
    rows += [(50, "to reach us dial EXTENSION or mailto:someone at night"), (51, "they like to dial in at times, or read on")]
    rows += [(52, "emails mailto:\x01odd now"), (53, "dial +1 (555) 777-4567 \x02 dial ABCDEF.")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_pii(frame(spark, rows)).collect()}
    assert got[50] == [(17, 4, 26), (37, 4, 44)] and got[0] == brute(rows[0][1])
    assert got[51] == []
    assert got[52] == [(15, 4, 18)] and got[53] == [(5, 3, 22), (30, 4, 36)]


def test_recall_of_unseen_identifiers(spark):
    """Identifiers of a form no pattern knows, in contexts that base spans share with them: all are found, and no word elsewhere."""
    r = random.Random(4)
    ways = ["contact: {}", "account={}", "user id {}", "call {}"]
    rows = [(k, f"note {k} {r.choice(ways).format(f'u{k}@mail.example')} end of note") for k in range(200)]
    hidden = {1000 + k: "".join(r.choice("abcxyz019") for _ in range(8)) for k in range(60)}
    rows += [(i, f"note {r.choice(ways).format(v)} end") for i, v in hidden.items()] + [(2000 + k, "plain words that say nothing of accounts or of users") for k in range(50)]
    texts = dict(rows)
    got = {r.doc_id: [texts[r.doc_id][s.start : s.stop] for s in r.spans if s.kind == 4] for r in pii.find_pii(frame(spark, rows)).collect()}
    assert sum(got[i] == [v] for i, v in hidden.items()) >= 0.95 * len(hidden)
    assert not any(got[2000 + k] for k in range(50))


def test_many_matches_in_a_very_long_text(spark):
    text = " ".join(f"u{k}@mail.example some {k}.1.2.3 words" for k in range(40000))
    assert len(text) > 1 << 20
    (row,) = pii.find_pii(frame(spark, [(1, text)])).collect()
    assert [tuple(s) for s in row.base] == brute(text)


def test_plan_has_no_python(spark, sf):
    plan = pii.op3_contextual_pii(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(spark):
    assert pii.find_pii(frame(spark, [])).collect() == []
