import numpy as np
import pytest

from quernstone.llm import mixing as mx
from tests.llm.helpers import awkward, frame


def test_totals_match_the_targets(spark, sf):
    rows = mx.op1_mixing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(rows) == docs.count()
    p, n, r = np.array([x.posterior for x in rows]), np.array([x.n_tokens for x in rows]), np.array([x.rate for x in rows])
    names = sorted({f"q{x.quality}t{x.toxic}" for x in spark.read.parquet(f"{sf}/labels.parquet").collect()})
    share = np.array([mx.SHARES[k] for k in names])
    want = mx.BUDGET * n.sum() * share / share.sum()
    assert np.abs((n * r) @ p - want).max() < 0.003 * n.sum()
    assert (r >= 0).all() and np.allclose(p.sum(1), 1)


def test_rates_are_the_least_squares_solution(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    n = rng.integers(1, 500, 300)
    scored = spark.createDataFrame([(int(k), int(a), b.tolist()) for k, (a, b) in enumerate(zip(n, p))], "doc_id long, n_tokens long, posterior array<double>")
    want = np.array([0.6, 0.3, 0.1]) * n.sum()
    duals, seen = mx.fit_rates(scored, lambda _: want)
    # plain projected gradient on the driver
    r = np.ones(300)
    for _ in range(4000):
        r = np.maximum(0, r - p @ (((n * r) @ p - want) / n.sum()))
    best = np.square((n * r) @ p - want).sum()
    x = mx.rates_of(p, duals)[0]
    assert np.square((n * x) @ p - want).sum() <= best + (0.001 * n.sum()) ** 2


def test_classifier_beats_the_majority(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    names, scored = mx.classify(docs.select("doc_id", "text"), labels.filter("doc_id % 2 = 0"))
    truth = {r.doc_id: f"q{r.quality}t{r.toxic}" for r in labels.filter("doc_id % 2 = 1").collect()}
    got = {r.doc_id: names[int(np.argmax(r.posterior))] for r in scored.collect() if r.doc_id in truth}
    common = max(truth.values(), key=list(truth.values()).count)
    assert np.mean([got[i] == v for i, v in truth.items()]) > 0.05 + np.mean([v == common for v in truth.values()])


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(5, 1, 0, "z"), (5, 0, 1, "z"), (None, 1, 0, "z"), (7, None, 0, "z"), (8, 0, 0, "z")], "doc_id long, quality int, toxic int, text string")
    rows = awkward(1) + [(None, "no id"), (5, "again")]
    got = mx.mix(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 for r in got)
    assert mx.mix(frame(spark, []), labels).collect() == []
    assert {r.domain for r in mx.mix(frame(spark, rows), labels.limit(0)).collect()} == {"all"}


def test_small_targets_are_met_with_soft_posteriors(spark):
    rng = np.random.default_rng(0)
    prior = np.array([0.13, 0.02, 0.76, 0.09])
    y = rng.choice(4, 3000, p=prior)
    logits = np.log(prior) + rng.normal(size=(3000, 4)) + 2 * np.eye(4)[y]
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    n = rng.integers(1, 500, 3000)
    scored = spark.createDataFrame([(k, int(a), b.tolist()) for k, (a, b) in enumerate(zip(n, p))], "doc_id long, n_tokens long, posterior array<double>")
    want = 0.8 * n.sum() * np.array([0.075, 0.004, 0.917, 0.004])
    duals, _ = mx.fit_rates(scored, lambda _: want)
    assert (np.abs((n * mx.rates_of(p, duals)[0]) @ p - want) <= 0.001 * want).all()


def test_targets_out_of_reach_are_warned_of(spark):
    scored = spark.createDataFrame([(k, 10, [0.5, 0.5]) for k in range(9)], "doc_id long, n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="out of reach"):
        duals, _ = mx.fit_rates(scored, lambda n: np.array([40.0, 20.0]))
    assert np.allclose(mx.rates_of(np.full((9, 2), 0.5), duals)[0], 2 / 3)


def test_any_number_of_domains_and_repeated_ids(spark):
    labels = spark.createDataFrame([(k, k, 0) for k in range(70)], "doc_id long, quality int, toxic int")
    rows = [(k % 70, f"text number {k} of kind {k % 70}") for k in range(300)]
    got = mx.mix(frame(spark, rows), labels, shares={f"q{k}t0": 1.0 for k in range(70)}).collect()
    assert len(got) == 300 and {len(r.posterior) for r in got} == {70}


def test_rows_keep_their_columns(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    plain = {r.doc_id: r for r in mx.mix(docs, labels).collect()}
    rows = mx.mix_rows(docs.withColumnRenamed("lang", "rate"), labels).collect()
    assert len(rows) == len(plain) and all(r.text is not None and r.domain == plain[r.doc_id].domain for r in rows)
    assert np.allclose([r.rate for r in rows], [plain[r.doc_id].rate for r in rows])
