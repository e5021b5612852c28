"""Benchmark decontamination with an FM-index per training shard.

A shard is a chunk of whole documents.  Its words become symbols of the
alphabet that the test phrases use; any other word can't be part of a match,
so runs of alphabet words too short for the shortest phrase shrink to one
separator before the index is built.  The index is the Burrows-Wheeler
transform of that sequence in a wavelet matrix (ranks by level), the symbol
counts and every ``SAMPLE``-th suffix position.  All test phrases are searched
backwards at once, one vectorised rank per symbol and level, and occurrences
are located by walking to the next sampled position.

The phrases go to the workers in blocks of at most ``BLOCK_BYTES`` (measured
while they are read), each a broadcast that lies on the workers' disks.  One
pass takes a batch of rows through all blocks, one in memory at a time, so
there is neither a limit on the benchmark nor a shuffle.  Of a block's phrases
a shard's index is searched for those whose words it all has.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import textkernel as tk
from quernstone.llm.cluster import documents, id_text, named_again, numbered
from quernstone.llm.repetition import suffix_order

WINDOW = 13
SAMPLE = 8
BLOCK_BYTES = 8 << 20
PERCENT = 5
#: Rows put out at once.
ROWS_OUT = 512
END, OTHER = 0, 1  # the sequence's end and separators; words are 2 and more


class WaveletMatrix:
    """Ranks over a sequence of small integers, all vectorised over queries."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (values >> level) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol[k]`` stands before position ``at[k]``."""
        begin, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros):
            one = ((symbol >> level) & 1).astype(bool)
            b, a = ones[begin], ones[at]
            begin = np.where(one, zeros + b, begin - b)
            at = np.where(one, zeros + a, at - a)
        return at - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Backward search and location over ``text``, whose last symbol is ``END``."""

    def __init__(self, text: np.ndarray, top: int):
        sa = suffix_order(text)
        bwt = text[sa - 1]
        self.n = len(text)
        self.before = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=top + 1), out=self.before[1:])
        self.tree = WaveletMatrix(bwt, top)
        self.sampled = sa % SAMPLE == 0
        self.slot = np.cumsum(self.sampled) - 1
        self.positions = sa[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffix order of the suffixes that start with each row of ``phrases``."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            symbol = phrases[live, k]
            lo[live] = self.before[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.before[symbol] + self.tree.rank(symbol, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, rows, live, steps = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(live):
            found = self.sampled[rows[live]]
            done = live[found]
            out[done] = self.positions[self.slot[rows[done]]] + steps
            live = live[~found]
            symbol = self.tree.access(rows[live])
            rows[live] = self.before[symbol] + self.tree.rank(symbol, rows[live])
            steps += 1
        return out


@dataclass
class Phrases:
    """Distinct phrases of a block by length, in symbols, and the items of each."""

    alphabet: np.ndarray  # sorted word hashes
    by_length: dict[int, np.ndarray]
    items: dict[int, list[list[int]]]

    @property
    def shortest(self) -> int:
        return min(self.by_length, default=1)


def phrases_of(items: list[tuple[int, str | None]]) -> Phrases:
    """All windows of ``WINDOW`` words of the items; a shorter item is one phrase, an empty one none."""
    owners: dict[int, dict[tuple[int, ...], list[int]]] = defaultdict(dict)
    column = pa.array([t for _, t in items], pa.string())
    for chunk in tk.chunks(column):
        spans, h = tk.words(chunk, lower=True, keep=tk.ALNUM_WORDS)
        for k in range(chunk.n):
            seq = h[spans.ptr[k] : spans.ptr[k + 1]].tolist()
            width = min(WINDOW, len(seq))
            for at in range(len(seq) - width + 1) if seq else ():
                owners[width].setdefault(tuple(seq[at : at + width]), []).append(items[chunk.lo + k][0])
    alphabet = np.unique(np.array([w for found in owners.values() for p in found for w in p], np.uint64))
    by_length = {n: np.searchsorted(alphabet, np.array(list(found), np.uint64)) + 2 for n, found in owners.items()}
    return Phrases(alphabet, by_length, {n: [sorted(set(x)) for x in found.values()] for n, found in owners.items()})


def scan(chunk: tk.Chunk, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first word of each document, occurrence starts, ends, document, its items)`` in words of the chunk.

    The last two list each pair of a document and an item with an occurrence once.
    """
    spans, h = tk.words(chunk, lower=True, keep=tk.ALNUM_WORDS)
    none = np.zeros(0, np.int64)
    if not len(phrases.alphabet) or not len(h):
        return spans.ptr, none, none, none, none
    at = np.searchsorted(phrases.alphabet, h)
    at[at == len(phrases.alphabet)] = 0
    known = phrases.alphabet[at] == h
    runs = tk.spans_of(known, spans.ptr)
    long = runs.ends - runs.starts >= phrases.shortest
    starts, lengths = runs.starts[long], runs.ends[long] - runs.starts[long]
    if not len(starts):
        return spans.ptr, none, none, none, none
    word = tk.ragged(starts, lengths + 1)  # one place after each run for the separator
    sep = np.cumsum(lengths + 1) - 1
    text = np.where(word < len(at), at[np.minimum(word, len(at) - 1)] + 2, OTHER)
    text[sep] = OTHER
    index = FMIndex(np.append(text, END), len(phrases.alphabet) + 1)
    found_s, found_e, found_d, found_i = [none], [none], [none], [none]
    doc = spans.docs()
    present = np.zeros(len(phrases.alphabet) + 2, bool)
    present[text] = True
    for n, table in phrases.by_length.items():
        some = np.arange(len(table))
        for k in range(n):
            some = some[present[table[some, k]]]
        lo, hi = index.search(table[some])
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        places = word[index.locate(tk.ragged(lo[hit], hi[hit] - lo[hit]))]
        phrase = np.repeat(some[hit], hi[hit] - lo[hit])
        found_s.append(places)
        found_e.append(places + n)
        pairs = np.unique(doc[places] * len(table) + phrase)
        for d, p in zip((pairs // len(table)).tolist(), (pairs % len(table)).tolist()):
            own = phrases.items[n][p]
            found_d.append(np.full(len(own), d, np.int64))
            found_i.append(np.array(own, np.int64))
    s, e = tk.merge_spans(np.concatenate(found_s), np.concatenate(found_e))
    d, i = np.concatenate(found_d), np.concatenate(found_i)
    if len(d):
        d, i = np.unique(np.stack([d, i]), axis=1)
    return spans.ptr, s, e, d, i


def split_at(starts: np.ndarray, ends: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts merged spans where documents begin (touching spans of two documents were joined)."""
    inner = np.unique(ptr[1:-1])
    s = np.concatenate([starts, inner])
    keep = np.ones(len(s), bool)
    k = np.searchsorted(starts, inner, "right") - 1
    keep[len(starts) :] = (k >= 0) & (ends[np.maximum(k, 0)] > inner) & (starts[np.maximum(k, 0)] < inner) if len(starts) else False
    s = np.sort(s[keep])
    e = ends[np.searchsorted(starts, s, "right") - 1]
    e[:-1] = np.minimum(e[:-1], s[1:])
    return s, e


_SPANS = pa.list_(pa.int64())


def _take(blob, alone: bool) -> Phrases:
    """The phrases of a broadcast; kept for the next batch only if there is no other block."""
    phrases = blob.value
    if not alone:
        blob.__dict__.pop("_value", None)
    return phrases


def _search(blobs: list, text_col: str):
    """Fills ``n_words, spans`` (flat pairs of words) and ``items`` of each row from all blocks."""

    def run(batches):
        for batch in batches:
            spans, items, n_words = [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)], np.zeros(batch.num_rows, np.int64)
            for blob in blobs:
                phrases = _take(blob, len(blobs) == 1)
                for chunk in tk.chunks(batch.column(text_col)):
                    ptr, s, e, d, i = scan(chunk, phrases)
                    n_words[chunk.lo : chunk.hi] = np.diff(ptr)
                    s, e = split_at(s, e, ptr) if len(s) else (s, e)
                    own = np.searchsorted(s, ptr)
                    at = np.searchsorted(d, np.arange(chunk.n + 1))
                    for k in np.flatnonzero(np.diff(own)).tolist():
                        a, b, old = s[own[k] : own[k + 1]] - ptr[k], e[own[k] : own[k + 1]] - ptr[k], spans[chunk.lo + k]
                        if old:
                            a, b = tk.merge_spans(np.append(a, old[0::2]), np.append(b, old[1::2]))
                        spans[chunk.lo + k] = np.stack([a, b], 1).ravel().tolist()
                        items[chunk.lo + k].update(i[at[k] : at[k + 1]].tolist())
            found = {"n_words": pa.array(n_words), "spans": pa.array(spans, _SPANS), "items": pa.array([sorted(x) for x in items], _SPANS)}
            for lo in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(lo, ROWS_OUT)
                yield pa.RecordBatch.from_arrays([found[c].slice(lo, ROWS_OUT) if c in found else part.column(c) for c in part.schema.names], names=part.schema.names)
            tk.release()

    return run


def _passes(docs: DataFrame, benchmark: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``n_words, spans, items, n_hit, contaminated`` after all blocks of the benchmark."""
    empty = F.array().cast("array<bigint>")
    found = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": empty, "items": empty})
    context = docs.sparkSession.sparkContext
    blobs = [context.broadcast(phrases_of(block)) for block in blocks(benchmark)]
    found = found.mapInArrow(_search(blobs, text_col), found.schema)
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), F.lit(0).cast("long"), lambda n, k: n + F.get("spans", k + 1) - F.get("spans", k))
    found = found.withColumn("n_hit", F.when(F.size("spans") > 0, n_hit).otherwise(F.lit(0).cast("long")))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= PERCENT * F.col("n_words")))


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text"):
    """The benchmark's rows with an id and a text, in blocks of bounded size."""
    block, size = [], 0
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("i is not null and t is not null")
    for row in rows.toLocalIterator():
        block.append((row.i, row.t))
        size += len(row.t.encode())
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text, n_words, spans, items, n_hit, contaminated``.

    ``spans``: merged runs of hit words as start, end, start, end ... counted
    in words; ``items``: ids of the items found.  Words are runs of a-z, 0-9
    and non-ASCII after lower-casing.  A document is contaminated if at least
    5 % of its words are hit.  Null texts have no words; null items and items
    without words match nothing; repeated rows stay; an empty benchmark
    contaminates nothing; other columns are not looked at.
    """
    return _passes(id_text(docs, id_col, text_col), benchmark, "text")


def keep_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't contaminated.  No shuffle.

    Null and empty texts have no words and stay; repeated rows are judged each
    for itself; an empty table stays empty; ids are not looked at.
    """
    rows, names = numbered(docs)
    return named_again(_passes(rows, benchmark, names[text_col]).filter("not contaminated"), names)


def _cut(batches):
    for batch in batches:
        out, spans = [], batch.column("spans").to_pylist()
        for chunk in tk.chunks(batch.column("text")):
            w, _ = tk.words(chunk, keep=tk.ALNUM_WORDS | (tk.LOWER != np.arange(256)))
            for k in range(chunk.n):
                text, base, at, kept = chunk.text(k), int(chunk.offs[k]), 0, []
                pairs = spans[chunk.lo + k] or []
                for a, b in zip(pairs[0::2], pairs[1::2]):
                    kept.append(text[at : int(w.starts[w.ptr[k] + a]) - base])
                    at = int(w.ends[w.ptr[k] + b - 1]) - base
                out.append(b"".join([*kept, text[at:]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])


def remove_spans(found: DataFrame) -> DataFrame:
    """``doc_id, text`` without the words under the spans of :func:`find_contamination`.

    One row per row: null texts come back empty, null ids and repeated rows as
    they are, an empty table gives no rows.
    """
    return found.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, text string")


def op8_fm_index(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n)),
m AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, w)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
