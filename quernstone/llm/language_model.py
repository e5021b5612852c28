"""Log-likelihood of whole documents under a gated recurrent language model.

Corpus counts come first: every bucket sends the counts of its training words
to the words' shards and gets the corpus totals of all its words back (packed,
see :mod:`buckets`).  They give the base score, the ``VOCAB`` most frequent
words, and the probability of any other word given that it is one.

The model is a GRU over the vocabulary with a class-factored softmax: P(word) =
P(class) P(word | class), classes being runs of the frequency order of about
equal root-frequency mass.  It starts as the unigram model and is trained on
*all* training documents, split into ``ROUNDS`` disjoint parts: in a round each
bucket runs truncated back-propagation (``STEPS`` words, state carried on) over
its documents from the common weights, and the weights are averaged by words,
in a tree.  What is broadcast is the model, whose size depends on the constants
below alone.  Buckets follow from the ids and the bytes of all texts, their
rows are sorted and their weights added in order: scores are a function of the
table and not of how Spark has partitioned it.

Scoring carries the state from window to window to each document's end, so
the whole text counts.  Documents run side by side in lanes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import buckets as bk
from quernstone.llm import textkernel as tk
from quernstone.llm.cluster import cut, documents, id_text

VOCAB = 2048
CLASSES = 32
HIDDEN = 16
STEPS = 16
LANES, FEW_LANES = 512, 32
#: Optimizer steps that a part of the training texts allows at least, by having fewer lanes.
WINDOWS = 64
#: Words whose probabilities are computed together.
SCORE_ROWS = 8192
ROUNDS = 3
RATE = 0.02
FAN_IN = 16
#: Logits are held within this, so that sums of their exponentials stay finite.
LIMIT = 60.0
END = np.uint64(0xE5D0A7C3B1F49682)
FOLDS, HELD_OUT = 5, 1

_f = np.float32


class Model:
    """GRU weights as one flat vector, with views by name."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, others: int = 0):
        """``words``: hashes in order of frequency; the symbol after the last stands for all others, ``others`` in number."""
        self.sorted = np.argsort(words)
        self.words = words[self.sorted]
        self.n = len(words) + 1
        mass = np.cumsum(np.sqrt(np.append(counts, max(1, others)).astype(float)))
        self.class_of = np.minimum((mass / mass[-1] * classes - 1e-9).astype(np.int64), classes - 1)
        self.class_of = np.unique(self.class_of, return_inverse=True)[1].astype(np.int16)
        self.k = int(self.class_of[-1]) + 1
        self.limits = np.searchsorted(self.class_of, np.arange(self.k + 1))
        self.h = hidden
        self.shapes = {"E": (self.n, 3 * hidden), "U": (hidden, 3 * hidden), "Wc": (hidden, self.k), "bc": (self.k,), "Ww": (hidden, self.n), "bw": (self.n,)}
        r = np.random.default_rng(7)
        share = np.append(counts, max(1, others)) + 0.5
        start = {name: (r.normal(0, 0.1 if name == "E" else 1 / math.sqrt(hidden) / 2, shape)) for name, shape in self.shapes.items()}
        start["bw"] = np.log(share / np.add.reduceat(share, self.limits[:-1])[self.class_of])
        start["bc"] = np.log(np.add.reduceat(share, self.limits[:-1]) / share.sum())
        self.flat = np.concatenate([start[name].ravel() for name in self.shapes]).astype(_f)

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            out[name] = flat[at : at + size].reshape(shape)
            at += size
        return out

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int32)
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, self.sorted[at], self.n - 1).astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, _f(0.5), out=x)
    np.tanh(x, out=x)
    x *= _f(0.5)
    x += _f(0.5)
    return x


def forward(w: dict, x: np.ndarray, h: np.ndarray, live: np.ndarray, keep: bool):
    """States before each word of the window ``x`` (steps, lanes), the state after it, and what the way back needs.

    ``live`` is 0 where a document ends, whose state is not carried on.
    """
    steps, lanes = x.shape
    k = h.shape[1]
    states, saved = np.empty((steps, lanes, k), _f), []
    for t in range(steps):
        states[t] = h
        gx, gh = w["E"][x[t]], h @ w["U"]
        zr = _sigmoid(gx[:, : 2 * k] + gh[:, : 2 * k])
        z, r, un = zr[:, :k], zr[:, k:], gh[:, 2 * k :]
        n = np.tanh(gx[:, 2 * k :] + r * un)
        if keep:
            saved.append((z, r, n, un))
        h = (n + z * (h - n)) * live[t][:, None]
    return states, h, saved


def log_probs(model: Model, w: dict, states: np.ndarray, words: np.ndarray, grads: dict | None = None):
    """Natural log-probability of each word; with ``grads``, also adds to them and returns d loss / d state."""
    m = len(words)
    cls = model.class_of[words]
    rows = np.arange(m)
    logit = np.clip(states @ w["Wc"] + w["bc"], -LIMIT, LIMIT)
    p = np.exp(logit)
    total = p @ np.ones(model.k, p.dtype)
    out = logit[rows, cls] - np.log(total)
    back = None
    if grads is not None:
        p /= total[:, None]
        p[rows, cls] -= 1
        grads["Wc"] += states.T @ p
        grads["bc"] += p.sum(0)
        back = p @ w["Wc"].T
    order = np.argsort(cls, kind="stable")
    at = np.searchsorted(cls[order], np.arange(model.k + 1))
    for c in range(model.k):
        own = order[at[c] : at[c + 1]]
        a, b = int(model.limits[c]), int(model.limits[c + 1])
        if not len(own) or b - a == 1:
            continue
        s, target = states[own], words[own] - a
        logit = np.clip(s @ w["Ww"][:, a:b] + w["bw"][a:b], -LIMIT, LIMIT)
        p = np.exp(logit)
        total = p @ np.ones(b - a, p.dtype)
        r = np.arange(len(own))
        out[own] += logit[r, target] - np.log(total)
        if grads is not None:
            p /= total[:, None]
            p[r, target] -= 1
            grads["Ww"][:, a:b] += s.T @ p
            grads["bw"][a:b] += p.sum(0)
            back[own] += p @ w["Ww"][:, a:b].T
    return out, back


def backward(w: dict, x: np.ndarray, states: np.ndarray, saved: list, live: np.ndarray, back: np.ndarray, grads: dict) -> None:
    steps, lanes, k = states.shape
    gates = np.empty((steps, lanes, 3 * k), _f)
    through = np.empty((steps, lanes, 3 * k), _f)
    dh = np.zeros((lanes, k), _f)
    for t in reversed(range(steps)):
        z, r, n, un = saved[t]
        dh = dh * live[t][:, None]
        da = dh * (1 - z) * (1 - n * n)
        gates[t, :, :k] = dh * (states[t] - n) * z * (1 - z)
        gates[t, :, k : 2 * k] = da * un * r * (1 - r)
        gates[t, :, 2 * k :] = da
        through[t, :, : 2 * k] = gates[t, :, : 2 * k]
        through[t, :, 2 * k :] = da * r
        dh = dh * z + through[t] @ w["U"].T + back[t]
    grads["U"] += states.reshape(-1, k).T @ through.reshape(-1, 3 * k)
    flat, words = gates.reshape(-1, 3 * k), x.ravel()
    order = np.argsort(words, kind="stable")
    first = np.flatnonzero(np.append(True, words[order][1:] != words[order][:-1]))
    grads["E"][words[order][first]] += np.add.reduceat(flat[order], first, axis=0)


def lanes_of(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, longest first to the shortest lane."""
    import heapq

    heap = [(0, k) for k in range(min(lanes, len(lengths)))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable").tolist():
        size, k = heapq.heappop(heap)
        out[k].append(d)
        heapq.heappush(heap, (size + int(lengths[d]), k))
    return sorted(out, key=lambda own: -int(lengths[own].sum()))


class Adam:
    def __init__(self, size: int):
        self.m, self.v, self.t = np.zeros(size, _f), np.zeros(size, _f), 0

    def step(self, flat: np.ndarray, grad: np.ndarray, rate: float) -> None:
        self.t += 1
        self.m += _f(0.1) * (grad - self.m)
        self.v += _f(0.01) * (grad * grad - self.v)
        flat -= _f(rate * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)) * self.m / (np.sqrt(self.v) + _f(1e-6))


def run(model: Model, flat: np.ndarray, tokens: np.ndarray, ptr: np.ndarray, adam: Adam | None = None, lanes: int = LANES) -> np.ndarray:
    """Log-probabilities of all ``tokens``; with ``adam``, learns from each window on the way (``flat`` changes)."""
    w, lengths = model.views(flat), np.diff(ptr)
    out = np.zeros(len(tokens), _f)
    if not len(tokens):
        return out
    last = np.zeros(len(tokens), bool)
    last[ptr[1:][lengths > 0] - 1] = True
    if adam is not None:  # lanes of equal length; the few documents that they cut begin anew
        lanes = max(1, min(lanes, len(tokens) // (STEPS * WINDOWS)))
        places = np.array_split(np.arange(len(tokens)), lanes)
    else:  # whole documents; no more lanes than the longest one leaves work for
        lanes = max(FEW_LANES, min(lanes, len(tokens) // int(lengths.max())))
        places = [np.concatenate([np.arange(ptr[d], ptr[d + 1]) for d in own]) for own in lanes_of(lengths, lanes)]
    size = np.array([len(p) for p in places])
    at = np.zeros((int(size[0]), len(places)), np.int64)
    for k, p in enumerate(places):
        at[: len(p), k] = p
    h = np.zeros((len(places), model.h), _f)
    waiting: list[tuple] = []  # states and places whose words are not scored yet
    for t in range(0, int(size[0]), STEPS):
        n = int(np.searchsorted(-size, -t, "left"))  # lanes with words left
        place = at[t : t + STEPS, :n]
        there = np.arange(t, t + len(place))[:, None] < size[:n]
        x = tokens[place]
        live = (~last[place] & there).astype(_f)
        states, h, saved = forward(w, x, h[:n], live, adam is not None)
        used = there.ravel()
        flat_states = states.reshape(-1, model.h)
        if adam is None:
            waiting.append((flat_states[used], place.ravel()[used]))
            if sum(len(p) for _, p in waiting) >= SCORE_ROWS or t + STEPS >= size[0]:
                scored, where = (np.concatenate(c) for c in zip(*waiting))
                out[where] = log_probs(model, w, scored, tokens[where])[0]
                waiting = []
            continue
        g = np.zeros_like(flat)
        grads = model.views(g)
        lp, back = log_probs(model, w, flat_states[used], x.ravel()[used], grads)
        out[place.ravel()[used]] = lp
        db = np.zeros_like(flat_states)
        db[used] = back
        backward(w, x, states, saved, live, db.reshape(states.shape), grads)
        g /= max(1, int(used.sum()))
        g *= _f(min(1.0, 1.0 / (float(np.sqrt((g * g).sum())) + 1e-9)))
        adam.step(flat, g, RATE)
    return out


def _tokens(column, to_symbol) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts of a column, each text followed by its end; ``ptr`` delimits the texts."""
    parts, counts = [], []
    for chunk in tk.chunks(column):
        spans, h = tk.words(chunk, lower=True)
        n = spans.counts
        full = np.full(len(h) + chunk.n, END, np.uint64)
        full[np.arange(len(h)) + np.repeat(np.arange(chunk.n), n)] = h
        parts.append(to_symbol(full))
        counts.append(n + 1)
    if not parts:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    return np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(counts)))


def _send_counts(shards: int):
    """Bucket to shard: its words and how often its training texts have them."""

    def go(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        held = np.array(table.column("held_out").to_pylist(), bool)
        tokens, ptr = _tokens(table.column("text"), lambda x: x)
        words, inverse = np.unique(tokens, return_inverse=True)
        counts = np.bincount(inverse, np.repeat(~held, np.diff(ptr)), minlength=len(words)).astype(np.uint32)
        order, at = bk.by_shard(words, shards)
        words, counts = words[order], counts[order]
        cuts = list(zip(range(shards), at[:-1].tolist(), at[1:].tolist()))
        cuts = [c for c in cuts if c[1] < c[2]]
        return pa.table({"shard": pa.array([s for s, _, _ in cuts], pa.int32()), "bucket": pa.array([bucket] * len(cuts), pa.int32()), "words": pa.array([words[a:b].tobytes() for _, a, b in cuts], pa.binary()), "counts": pa.array([counts[a:b].tobytes() for _, a, b in cuts], pa.binary())})

    return go


ANSWER = "bucket int, part int, words binary, counts binary, wide boolean, n long, v long"


def _answer(rows: list[tuple]) -> pa.Table:
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64())
    return pa.table({f.split()[0]: pa.array([r[k] for r in rows], t) for k, (f, t) in enumerate(zip(ANSWER.split(", "), types))})


def _top(words: np.ndarray, counts: np.ndarray, k: int = VOCAB) -> tuple[np.ndarray, np.ndarray]:
    best = np.lexsort((words, -counts))[:k]
    return words[best], counts[best]


def _total_counts(table: pa.Table) -> pa.Table:
    """Shard to buckets: corpus totals of their words; and (bucket -1) the shard's size and most frequent words."""
    words, n = bk.joined(table.column("words"), np.uint64)
    counts, _ = bk.joined(table.column("counts"), np.uint32)
    distinct, inverse = np.unique(words, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, inverse, counts)
    wide = bool(total.max(initial=0) >= 1 << 32)
    packed = total[inverse].astype(np.int64 if wide else np.uint32)
    at = np.append(0, np.cumsum(n))
    shard = table.column("shard")[0].as_py()
    rows = [(b, shard, words[i:j].tobytes(), packed[i:j].tobytes(), wide, None, None) for b, i, j in zip(table.column("bucket").to_pylist(), at[:-1], at[1:])]
    known = total > 0
    w, c = _top(distinct[known], total[known])
    return _answer([*rows, (-1, shard, w.tobytes(), c.tobytes(), True, int(total.sum()), int(known.sum()))])


def _merge_tops(batches):
    w, c, n, v = [], [], 0, 0
    for batch in batches:
        w.append(bk.joined(pa.chunked_array([batch.column("words")]), np.uint64)[0])
        c.append(bk.joined(pa.chunked_array([batch.column("counts")]), np.int64)[0])
        n += sum(batch.column("n").to_pylist())
        v += sum(batch.column("v").to_pylist())
    if w:
        top = _top(np.concatenate(w), np.concatenate(c))
        yield _answer([(-1, 0, top[0].tobytes(), top[1].tobytes(), True, n, v)]).to_batches()[0]


def in_tree(df: DataFrame, merge, schema: str) -> list:
    """Merges the one row of each partition, ``FAN_IN`` at a time; the driver gets ``FAN_IN`` rows at most."""
    n = df.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        df = df.repartition(n).mapInArrow(merge, schema)
    return df.collect()


WEIGHTS = "bucket int, flat binary, n long"


def _weights(bucket: int, flat: np.ndarray, n: int) -> pa.Table:
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "flat": pa.array([flat.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})


def _train(shared):
    """A bucket's documents of this round; its weights times its words."""

    def go(table: pa.Table) -> pa.Table:
        table = bk.canonical(table)
        model, flat = shared.value
        flat = flat.copy()
        tokens, ptr = _tokens(table.column("text"), model.symbols)
        run(model, flat, tokens, ptr, Adam(len(flat)))
        return _weights(table.column("bucket")[0].as_py(), flat.astype(np.float64) * len(tokens), len(tokens))

    return go


def _add_weights(table: pa.Table) -> pa.Table:
    """The sum of some buckets' weights, in order of the buckets."""
    table, total = table.sort_by("bucket"), 0.0
    for flat in table.column("flat"):
        total = total + np.frombuffer(flat.as_buffer(), np.float64)
    return _weights(table.column("bucket")[0].as_py() // FAN_IN, total, sum(table.column("n").to_pylist()))


def average(rows: DataFrame, buckets: int) -> np.ndarray | None:
    """The weights of all buckets, averaged by words; the driver gets ``FAN_IN`` of them at most."""
    while buckets > FAN_IN:
        rows = rows.withColumn("parent", F.floor(F.col("bucket") / FAN_IN).cast("int")).groupBy("parent").applyInArrow(_add_weights, WEIGHTS)
        buckets = -(-buckets // FAN_IN)
    found = sorted(rows.collect())
    return sum(np.frombuffer(x.flat, np.float64) for x in found) / sum(x.n for x in found) if found else None


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shared, n_all: int, v_all: int, n_other: int, v_other: int):
    def go(docs: pa.Table, answers: pa.Table) -> pa.Table:
        model, flat = shared.value
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])  # the lanes, and with them the rounding, follow the order
        words, _ = bk.joined(answers.column("words"), np.uint64)
        wide = answers.column("wide").to_pylist()
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(c, np.int64 if k else np.uint32).astype(np.int64) for c, k in zip(answers.column("counts").to_pylist(), wide))])
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        tokens, ptr = _tokens(docs.column("text"), lambda x: x)
        count = counts[np.searchsorted(words, tokens)] if len(tokens) else np.zeros(0, np.int64)
        symbols = model.symbols(tokens)
        lp = run(model, flat.copy(), symbols, ptr, lanes=LANES).astype(np.float64) / math.log(10)
        other = symbols == model.n - 1
        lp[other] += np.log10((count[other] + 0.5) / (n_other + 0.5 * (v_other + 1)))
        base = np.log10((count + 0.5) / (n_all + 0.5 * (v_all + 1)))
        per_doc = lambda x: np.add.reduceat(x, ptr[:-1]) if len(ptr) > 1 else x[:0]
        n = docs.num_rows
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(np.diff(ptr), pa.int64()), "n_known": pa.array(per_doc((count > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array([n_all] * n, pa.int64()), "base_score": pa.array(per_doc(base), pa.float64()), "score": pa.array(per_doc(lp), pa.float64())})

    return go


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, with the columns of :data:`SCORES`.

    Learns from the documents whose crc32(id as text) mod 5 is not 1.  Null
    and empty texts are one end token; a null id counts as the empty text.
    Repeated rows count each; other columns are not looked at.  Without
    training documents all words share one probability.  An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    docs = id_text(docs, id_col, text_col)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    n = bk.buckets_for(docs)
    dealt = bk.bucketed(docs, n).withColumn("held_out", fold == HELD_OUT)
    counts = dealt.groupBy("bucket").applyInArrow(_send_counts(n), "shard int, bucket int, words binary, counts binary")
    answers = cut(counts.groupBy("shard").applyInArrow(_total_counts, ANSWER))
    tops = in_tree(answers.filter("bucket = -1").mapInArrow(_merge_tops, ANSWER), _merge_tops, ANSWER)
    n_all, v_all = sum(t.n for t in tops), sum(t.v for t in tops)
    words, freq = _top(*(np.concatenate([np.zeros(0, t), *(np.frombuffer(x[c], t) for x in tops)]) for c, t in (("words", np.uint64), ("counts", np.int64))))
    n_other, v_other = n_all - int(freq.sum()), v_all - len(freq)
    model = Model(words, freq, others=n_other)
    flat = model.flat
    for r in range(ROUNDS):
        part = bk.bucketed(docs.filter((fold != HELD_OUT) & (F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS)) == r)), n)
        shared = spark.sparkContext.broadcast((model, flat))
        learned = average(part.groupBy("bucket").applyInArrow(_train(shared), WEIGHTS), n)
        if learned is not None:
            flat = learned.astype(_f)
    shared = spark.sparkContext.broadcast((model, flat))
    score = _score(shared, n_all, v_all, n_other, v_other)
    return dealt.groupBy("bucket").cogroup(answers.filter("bucket >= 0").groupBy("bucket")).applyInArrow(score, SCORES)


def op5_recurrent_lm(spark, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
