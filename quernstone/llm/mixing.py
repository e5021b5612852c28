"""Mixing documents to target weights with soft domain membership.

1. A softmax classifier over the most telling cues learns the domains that the
   label table names (pairs of quality and toxic) from at most ``MAX_LABELLED``
   labelled documents, those of least id hash; every document then gets the
   posterior of each domain.
2. A document at rate r is expected r times in the mix and gives each domain
   r * tokens * posterior.  Nonnegative rates are fitted by least squares so
   that the domains' expected totals match the targets: projected gradient
   steps with momentum in the metric of the token counts, each residual scaled
   by its domain's tokens, in which one step length fits every corpus.  Each
   step also tries residuals scaled by the inverse of the domains' k x k
   matrix, of all documents and of those with a rate above 0, with and without
   momentum, and takes what is best by the scaled squares; the plain step is
   among them, so none is worse than that.  The
   gradient at a document depends on its posterior and on the domains'
   residuals only, so a step is one aggregate of a few numbers; the rates are
   recomputed from the steps so far, which are folded into two numbers a
   document every ``FOLD`` steps, and never collected.  Steps go on until every
   domain is within ``TOLERANCE`` of its own target or nothing moves any more;
   a target that isn't met is warned of.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quernstone.llm import textkernel as tk
from quernstone.llm.cluster import cut, documents, id_text, numbered
from quernstone.llm.repetition import SYMBOLS

FEATURES = 1 << 13
MIN_DOCUMENTS = 3
MAX_LABELLED = 8000
EPOCHS, RATE, DECAY = 8, 0.1, 1e-5
STEPS, FOLD = 400, 50
#: Of a domain's own target (of 1 % of all targets for smaller ones); the root mean square of the rates' moves at which
#: they stand still; and the part of the squared misses that 20 steps have to take away.
TOLERANCE, STILL, STALL = 1e-4, 1e-7, 1e-3
LENGTHS = (1.0, 0.5, 0.25, 0.0625)
#: Share of the corpus' tokens that the mix has, and the domains' shares of the mix (in proportion, over the domains there are).
BUDGET = 0.8
SHARES = {"q1t0": 0.917, "q0t0": 0.075, "q1t1": 0.004, "q0t1": 0.004}


def _cues(column):
    """Per chunk: the document and the hash of each cue, words and shapes, and the texts' words.

    Cues are the words, the last two bytes of each word, and tenths of four
    shares: upper-case letters, symbols, repeated words, repeated line starts.
    """
    for chunk in tk.chunks(column):
        spans, h = tk.words(chunk, lower=True)
        doc, n = spans.docs(), spans.counts
        tail = chunk.buf[spans.ends - 1].astype(np.uint64) | (chunk.buf[np.maximum(spans.ends - 2, spans.starts)].astype(np.uint64) << np.uint64(8)) if len(h) else h
        if chunk.n < 1 << 20:  # the document above, 44 bits of the word below
            own = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
            distinct = np.bincount((own[np.append(True, own[1:] != own[:-1])] >> np.uint64(44)).astype(np.int64), minlength=chunk.n) if len(h) else np.zeros(chunk.n, np.int64)
        else:
            distinct = np.bincount(_distinct(doc, h)[0], minlength=chunk.n)
        size = np.maximum(np.diff(chunk.offs), 1)
        share = [_count(tk.LOWER[chunk.buf] != chunk.buf, chunk.offs) / size, _count(SYMBOLS[chunk.buf], chunk.offs) / size, 1 - distinct / np.maximum(n, 1), np.minimum(n, 1000) / 1000]
        shape = [np.minimum(10 * x, 9).astype(np.uint64) + np.uint64(0x20000 + 16 * k) for k, x in enumerate(share)]
        every = np.arange(chunk.n)
        yield chunk, n, np.concatenate([doc, doc, *[every] * 4]), np.concatenate([h, tk.mix(tail + np.uint64(0x10000)), *(tk.mix(x) for x in shape)])


def _count(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags))
    return total[offs[1:]] - total[offs[:-1]]


def _present(vocabulary: np.ndarray, doc: np.ndarray, cue: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a document and a cue of the (sorted) vocabulary."""
    at = np.searchsorted(vocabulary, cue)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == cue if len(vocabulary) else np.zeros(len(cue), bool)
    size = max(1, len(vocabulary))
    pairs = np.sort(doc[hit] * size + at[hit])
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
    return pairs // size, pairs % size


def _logits(w: np.ndarray, bias: np.ndarray, n: int, doc: np.ndarray, cue: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(doc, w[cue, c], minlength=n) for c in range(w.shape[1])], 1) + bias


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _fit(k: int):
    """Trains in one task on the bounded sample; one row with the vocabulary and the weights."""

    def run(batches):
        docs, cues, y = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], []
        for batch in batches:
            for chunk, _, doc, cue in _cues(batch.column("text")):
                pairs = _distinct(doc, cue)
                docs.append(len(y) + chunk.lo + pairs[0])
                cues.append(pairs[1])
            y += batch.column("domain").to_pylist()
        doc, cue, y = np.concatenate(docs), np.concatenate(cues), np.array(y, np.int64)
        found, inverse, df = np.unique(cue, return_inverse=True, return_counts=True)
        own = np.zeros((len(found), k))
        np.add.at(own, (inverse, y[doc]), 1)
        total = np.bincount(y, minlength=k) + 1.0
        odds = np.log((own + 0.1) / total) - np.log((df[:, None] - own + 0.1) / (total.sum() - total))
        worth = (np.abs(odds) * np.sqrt(np.maximum(own, 0.0) + df[:, None] * 0.01)).max(1) if k > 1 else df.astype(float)
        keep = np.flatnonzero(df >= MIN_DOCUMENTS)
        keep = np.sort(keep[np.argsort(-worth[keep], kind="stable")[:FEATURES]])
        vocabulary = found[keep]
        slot = np.full(len(found), -1)
        slot[keep] = np.arange(len(keep))
        at = slot[inverse]
        doc, at = doc[at >= 0], at[at >= 0]
        order = np.argsort(doc, kind="stable")
        doc, at = doc[order], at[order]
        ptr = np.searchsorted(doc, np.arange(len(y) + 1))
        w, bias = np.zeros((len(vocabulary), k)), np.log(total / total.sum())
        g2 = np.full_like(w, 1e-8)
        r = np.random.default_rng(11)
        for _ in range(EPOCHS if k > 1 else 0):
            shuffled = r.permutation(len(y))
            for lo in range(0, len(y), 64):
                rows = shuffled[lo : lo + 64]
                n = ptr[rows + 1] - ptr[rows]
                some, who = at[tk.ragged(ptr[rows], n)], np.repeat(np.arange(len(rows)), n)
                p = _softmax(_logits(w, bias, len(rows), who, some))
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                g = np.stack([np.bincount(some, p[who, c], minlength=len(w)) for c in range(k)], 1) + DECAY * w
                g2 += g * g
                w -= RATE * g / np.sqrt(g2)
                bias -= 0.01 * p.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (vocabulary, w, bias)], names=["v", "w", "b"])

    return run


def _distinct(doc: np.ndarray, cue: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((cue, doc))
    doc, cue = doc[order], cue[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (cue[1:] != cue[:-1]))
    return doc[new], cue[new]


def _predict(shared):
    def run(batches):
        for batch in batches:
            for chunk, n, p in _posterior(batch.column("text"), shared.value):
                flat = pa.ListArray.from_arrays(pa.array(np.arange(chunk.n + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.lo, chunk.n), pa.array(n, pa.int64()), flat], names=["doc_id", "n_tokens", "posterior"])
            tk.release()

    return run


def _posterior(column, model):
    vocabulary, w, bias = model
    for chunk, n, doc, cue in _cues(column):
        yield chunk, n, _softmax(_logits(w, bias, chunk.n, *_present(vocabulary, doc, cue)))


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[str], tuple]:
    """Domain names and the classifier's vocabulary, weights and biases."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit("q"), F.col("quality").cast("int"), F.lit("t"), F.col("toxic").cast("int")).alias("name")).filter("doc_id is not null and name is not null").groupBy("doc_id").agg(F.min("name").alias("name"))
    names = sorted(r.name for r in known.select("name").distinct().collect()) or ["all"]  # the label table's kinds
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).select("doc_id", F.array_position(F.lit(names), F.col("name")).alias("domain"))
    # at most MAX_LABELLED pairs of numbers; and where ids repeat, at most so many rows
    rows = docs.join(F.broadcast(sample), "doc_id").select("text", (F.col("domain") - 1).cast("int").alias("domain"))
    rows = rows.orderBy(F.xxhash64("text"), "domain").limit(MAX_LABELLED)
    fitted = rows.coalesce(1).mapInArrow(_fit(len(names)), "v binary, w binary, b binary").collect()
    model = (np.zeros(0, np.uint64), np.zeros((0, len(names))), np.zeros(len(names)))
    if fitted:  # an empty sample may have no task
        model = (np.frombuffer(fitted[0].v, np.uint64), np.frombuffer(fitted[0].w, np.float64).reshape(-1, len(names)), np.frombuffer(fitted[0].b, np.float64))
    return names, model


def classify(docs: DataFrame, labels: DataFrame) -> tuple[list[str], DataFrame]:
    """Domain names and ``(doc_id, n_tokens, posterior)`` of every row of ``docs``."""
    names, model = train(docs, labels)
    return names, _scored(docs, model)


def _scored(docs: DataFrame, model) -> DataFrame:
    return docs.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, n_tokens long, posterior array<double>")


def rates_of(p: np.ndarray, duals: list[tuple[float, np.ndarray]], start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps ``duals`` (momentum, scaled residuals), and those before the last one."""
    x, last = start or (np.ones(len(p)), np.ones(len(p)))
    for beta, g in duals:
        x, last = np.maximum(0.0, x + beta * (x - last) - p @ g), x
    return x, last


def _posteriors(batch) -> np.ndarray:
    return np.array(batch.column("posterior").flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)


def _rates(batch, p, duals):
    start = (batch.column("rate").to_numpy(), batch.column("last").to_numpy()) if "rate" in batch.schema.names else None
    return rates_of(p, duals, start)


def _totals(duals, trials):
    """Per trial of a next step, one after the other: the domains' totals, the matrix of the documents it leaves a rate, the squares of the moves."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                p = _posteriors(batch)
                n = batch.column("n_tokens").to_numpy().astype(float)
                x, last = _rates(batch, p, duals)
                parts = []
                for trial in trials:
                    new = rates_of(p, [trial], (x, last))[0]
                    parts += [(n * new) @ p, ((p * (n * (new > 0))[:, None]).T @ p).ravel(), [n @ np.square(new - x)]]
                part = np.concatenate(parts)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["k", "v"])

    return run


def _assign(duals, last: bool = False):
    def run(batches):
        for batch in batches:
            p = _posteriors(batch) if batch.num_rows else np.zeros((0, 1))
            rates = _rates(batch, p, duals) if batch.num_rows else (np.zeros(0), np.zeros(0))
            kept = batch.select(["doc_id", "n_tokens", "posterior"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(x) for x in rates[: 1 + last])], names=[*kept.schema.names, "rate", "last"][: 4 + last])

    return run


def fit_rates(scored: DataFrame, targets) -> tuple[list[tuple[float, np.ndarray]], list[np.ndarray]]:
    """The steps that make the rates, and the domains' totals before each and at the end.

    ``targets``: maps the domains' token totals at rate 1 to the wanted ones.
    """
    duals, seen, recent, left, trials, age, still = [], [], [], [], None, 1.0, False
    for step in range(STEPS + 1):
        k = len(seen[0]) if seen else None
        if trials is None:  # rates 1: no step yet
            k = len((scored.select("posterior").first() or [[]])[0])
            trials = [(0.0, np.zeros(k))]
        rows = scored.mapInArrow(_totals(recent, trials), "k int, v double").groupBy("k").agg(F.sum("v")).orderBy("k").collect()
        if not rows:
            break
        got = np.array([r[1] for r in rows]).reshape(len(trials), k + k * k + 1)
        totals, active, moved = got[:, :k], got[:, k:-1].reshape(-1, k, k), got[:, -1]
        if not seen:
            n, want, full = totals[0], targets(totals[0]), np.linalg.pinv(active[0], rcond=1e-10, hermitian=True)
            scale = np.divide(1.0, n, out=np.zeros(k), where=n > 0)
            size, near = max(1.0, n.sum()), TOLERANCE * np.maximum(want, 0.01 * want.sum())
            best = 0
        else:
            misses = np.square(totals - want) @ scale
            best = int(np.argmin(misses))
            left.append(misses[best])
            still = moved[0] <= STILL**2 * size or left[-1] > (1 - STALL) * left[max(0, len(left) - 20)] and len(left) > 20  # of the plain step
            duals.append(trials[best])
            recent.append(trials[best])
        seen.append(totals[best])
        if still or (np.abs(seen[-1] - want) <= near).all() or step == STEPS:
            break
        if len(recent) == FOLD:
            scored, recent = cut(scored.mapInArrow(_assign(recent, True), "doc_id long, n_tokens long, posterior array<double>, rate double, last double")), []
        own = np.linalg.pinv(active[best], rcond=1e-10, hermitian=True)
        older, age = age, (1 + np.sqrt(1 + 4 * age * age)) / 2
        trials = []
        for beta in (0.0, (older - 1) / age):
            r = seen[-1] + beta * (seen[-1] - seen[max(0, len(seen) - 2)]) - want
            trials += [(beta, scale * r), (beta, full @ r), *((beta, c * (own @ r)) for c in LENGTHS)]
    if seen and not (np.abs(seen[-1] - want) <= near).all():
        warnings.warn(f"mixing: {'targets out of reach' if still else 'not converged'} after {len(duals)} steps: domains' totals {seen[-1].tolist()}, targets {want.tolist()}", stacklevel=2)
    return duals, seen


def _fitted(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None, budget: float):
    """``(names, model, posteriors of all rows, steps)``."""
    names, model = train(docs, labels)
    shares = shares or SHARES
    share = np.array([shares.get(k, 1.0 if names == ["all"] else 0.0) for k in names])
    share = share / share.sum() if share.sum() else share
    scored = cut(_scored(docs, model))
    return names, model, scored, fit_rates(scored, lambda n: budget * n.sum() * share)[0]


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, domain, posterior, rate``.

    ``posterior``: an array in the order of the domain names (sorted; pairs
    such as q1t0); ``domain``: the likeliest; ``rate``: how often the document
    is expected in the mix.  Domains without a share in ``shares`` get 0.
    Null and empty texts have no tokens, so they weigh nothing in the fit and
    get the rate of their posterior.  Null ids stay and match no label.  A
    document with several labels has the least; without labels all documents
    are of one domain.  Repeated rows count each; an empty table gives no rows.
    """
    docs = id_text(docs, id_col, text_col)
    names, _, scored, duals = _fitted(docs, labels, shares, budget)
    rated = scored.mapInArrow(_assign(duals), "doc_id long, n_tokens long, posterior array<double>, rate double")
    best = F.element_at(F.lit(names), F.array_position("posterior", F.array_max("posterior")).cast("int"))
    return rated.select("doc_id", "n_tokens", best.alias("domain"), "posterior", "rate")


RESULT = {"n_tokens": pa.int64(), "domain": pa.string(), "posterior": pa.list_(pa.float64()), "rate": pa.float64()}


def _rate_rows(shared, names: list[str], duals, text_col: str):
    def run(batches):
        for batch in batches:
            for chunk, n, p in _posterior(batch.column(text_col), shared.value):
                found = (n, [names[k] for k in p.argmax(1).tolist()], p.tolist(), rates_of(p, duals)[0])
                part = batch.slice(chunk.lo, chunk.n)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, t) for x, t in zip(found, RESULT.values()))], names=[*part.schema.names, *RESULT])
            tk.release()

    return run


def mix_rows(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and those of :func:`mix`; a column of the same name gives way.

    The texts aren't shuffled: once the steps are known, a row's rate follows
    from its own text, in one more pass.  Nulls, empty tables and repeated rows
    are as in :func:`mix`.
    """
    names, model, _, duals = _fitted(id_text(docs, id_col, text_col), labels, shares, budget)
    rows, own = numbered(docs)
    rows = rows.withColumn(own[text_col], F.col(own[text_col]).cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("n_tokens long, domain string, posterior array<double>, rate double").fields])
    rated = rows.mapInArrow(_rate_rows(shared, names, duals, own[text_col]), schema)
    return rated.select(*(F.col(n).alias(c) for c, n in own.items() if c not in RESULT), *RESULT)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
