"""Texts over a chunk (1 MB), each with its cases near the end, where a prefix would lose them."""

import random

import pytest

from quernstone.llm import chat
from quernstone.llm import decontaminate as dc
from quernstone.llm import language_model as lm
from quernstone.llm import license_scan as ls
from quernstone.llm import near_dup as nd
from quernstone.llm import repetition as rp
from tests.llm import test_decontaminate, test_license_scan, test_near_dup
from tests.llm.helpers import frame
from tests.llm.test_language_model import brute as base_scores


@pytest.fixture(scope="module")
def long():
    """About 1.6 MB of words, no two alike."""
    r = random.Random(11)
    return " ".join(f"{r.choice('abcdefg')}{k}{r.choice('uvé')}" for k in range(200_000))


def test_repetition(spark, long):
    repeat = " ".join(f"r{k}" for k in range(130))
    texts = {1: long, 2: f"{long}\n{repeat}\n{repeat}", 3: "\n".join(["a b c"] * 400_000)}
    got = {r.doc_id: r for r in rp.repetition_rules(frame(spark, [*texts.items()])).collect()}
    assert [(got[i].n_words, got[i].n_dup_lines, got[i].n_repeat_words, got[i].kept) for i in (1, 2, 3)] == [(200_000, 0, 0, True), (200_260, 1, 260, False), (1_200_000, 399_999, 1_200_000, False)]
    assert not got[2].base_failed and got[3].base_failed and got[2].word_chars == sum(map(len, texts[2].split()))


def test_language_model(spark, long):
    rows = [(1, long), (2, f"{long} tail"), (3, "some words"), (4, None)]
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score_documents(frame(spark, rows)).collect())
    for a, b in zip(got, base_scores(rows), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_licenses(spark, long):
    rows = [(1, long), (2, f"{long}\nReleased under the MIT License.")]
    got = {r.doc_id: {m.license for m in r.matches} for r in ls.scan_licenses(frame(spark, rows)).collect()}
    assert got == {1: set(), 2: test_license_scan.brute("x\nReleased under the MIT License.")} and got[2]


def test_decontamination(spark, long):
    items = [(1, " ".join(long.split()[-40:])), (2, "not to be found anywhere")]
    rows = [(1, long), (2, long.rsplit(" ", 41)[0]), (3, items[0][1])]
    got = dc.find_contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in got), key=str) == test_decontaminate.brute(rows, items)


def test_near_duplicates(spark, long):
    words = long.split()
    rows = [(1, long), (2, " ".join(words[:100_000] + ["x"] + words[100_000:])), (3, " ".join(words[:120_000])), (4, long)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(frame(spark, rows)).collect())
    assert got == test_near_dup.brute(rows)


def test_chat(spark, long):
    rows = [(1, 0, "user", long, "x", 1), (1, 1, "assistant", long + "<|im_end|>", "x", 1)]
    (row,) = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string, loss int"))).collect()
    assert (row.n_turns, row.loss_chars, row.valid) == (2, len(long) + 10, True)
