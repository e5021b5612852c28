"""Quality rules from repetition inside a document, by word suffix arrays.

All documents of a chunk are sorted at once: each word's first key joins the
document to the word, so no two suffixes of different documents share a
prefix and no common prefix crosses a text.  Prefix doubling refines only the
groups that are still tied.  The longest-common-prefix value of neighbours in
suffix order gives, for each position, the deepest LCP interval that holds it,
which is the longest repeat that starts there; those that no longer repeat to
their left contains are the maximal repeated substrings.  The verdict limits
the fraction of the text that their union covers and the longest of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quernstone.llm import textkernel as tk
from quernstone.llm.cluster import documents, id_text
from quernstone.workers import importable

WINDOW = 5
MIN_WORDS = 10
BASE_PERCENT = 20
#: Share of a text's word characters under maximal repeats of MIN_WORDS words and more; above what the base rule allows, so that one repeated sentence rejects nothing.
MAX_COVERED = 0.25
#: Words of the longest repeat.
MAX_LONGEST = 100

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_chars long, longest_repeat long, n_maximal long, kept boolean"


def suffix_order(first: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of integers by prefix doubling on tied groups."""
    n = len(first)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(first, kind="stable")
    key = first[order]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    sa = order.astype(np.int64)
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(head)
    rank[sa] = starts[np.cumsum(head) - 1]
    size = np.diff(np.append(starts, n))
    active = np.flatnonzero(np.repeat(size > 1, size))  # slots of sa whose group is tied
    step = 1
    while len(active):
        at = sa[active]
        after = at + step
        key = (rank[at] << 32) | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        sa[active] = at
        head = np.ones(len(at), bool)
        head[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(head)
        rank[at] = active[starts[np.cumsum(head) - 1]]
        size = np.diff(np.append(starts, len(at)))
        active = active[np.repeat(size > 1, size)]
        step *= 2
    return sa


def longest_repeats(doc: np.ndarray, ends: np.ndarray, hashes: np.ndarray, least: int = WINDOW) -> np.ndarray:
    """For each word, the length of the longest repeat that starts there (0 if under ``least``).

    ``doc``: the document of each word; ``ends``: where its document ends.
    """
    n = len(hashes)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    with np.errstate(over="ignore"):
        own = tk.mix(hashes ^ tk.mix(doc.astype(np.uint64) + np.uint64(1)))
    sa = suffix_order(own)
    up, down = tk.powers(n + 1)
    pre = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(own * up[:n], out=pre[1:])
    a, b = sa[:-1], sa[1:]
    pair = np.flatnonzero(own[a] == own[b])
    a, b = a[pair], b[pair]
    room = np.minimum(ends[a] - a, ends[b] - b)
    lcp = np.zeros(len(a), np.int64)
    bit = 1 << int(room.max(initial=0)).bit_length()
    while bit:
        more = np.flatnonzero(lcp + bit <= room)
        x, y = a[more] + lcp[more], b[more] + lcp[more]
        with np.errstate(over="ignore"):
            same = (pre[x + bit] - pre[x]) * down[x] == (pre[y + bit] - pre[y]) * down[y]
        lcp[more[same]] += bit
        bit >>= 1
    lcp[lcp < least] = 0
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def _covered(length: np.ndarray, least: int) -> np.ndarray:
    """Which words lie under a repeat of ``least`` words or more."""
    at = np.flatnonzero(length >= least)
    edge = np.zeros(len(length) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length[at], -1)
    return np.cumsum(edge[:-1]) > 0


def _per_doc(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[ptr[1:]] - total[ptr[:-1]]


def measure(chunk: tk.Chunk) -> dict[str, np.ndarray]:
    """The columns of :data:`SCHEMA` but the id, for one chunk."""
    spans, h = tk.words(chunk)
    doc, ptr, n_words = spans.docs(), spans.ptr, spans.counts
    cp = tk.code_points(chunk.buf)
    chars = cp[spans.ends] - cp[spans.starts]
    lines = tk.spans_of(chunk.buf != 10, chunk.offs)
    line_doc = lines.docs()
    with_word = np.searchsorted(spans.starts, lines.ends) > np.searchsorted(spans.starts, lines.starts)
    line_hash = tk.span_hash(tk.prefix_hash(chunk.buf), lines.starts, lines.ends)[with_word]
    line_doc = line_doc[with_word]
    with np.errstate(over="ignore"):
        first = np.unique(line_hash ^ tk.mix(line_doc.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    n_dup = np.bincount(line_doc, minlength=chunk.n) - np.bincount(line_doc[first], minlength=chunk.n)
    length = longest_repeats(doc, np.repeat(ptr[1:], n_words), h)
    end = np.arange(len(length)) + length
    maximal = length >= MIN_WORDS
    maximal[1:] &= ~((doc[1:] == doc[:-1]) & (end[1:] <= end[:-1]))
    longest = np.zeros(chunk.n, np.int64)
    np.maximum.at(longest, doc, length)
    out = {"n_words": n_words, "word_chars": _per_doc(chars, ptr), "n_symbols": _per_doc(SYMBOLS[chunk.buf], chunk.offs), "n_dup_lines": n_dup, "n_repeat_words": _per_doc(_covered(length, WINDOW), ptr)}
    out["base_failed"] = (n_words < 10) | (100 * out["n_repeat_words"] > BASE_PERCENT * n_words)
    out["covered_chars"] = _per_doc(chars * _covered(length, MIN_WORDS), ptr)
    out["longest_repeat"], out["n_maximal"] = longest, _per_doc(maximal, ptr)
    out["kept"] = ~out["base_failed"] & (out["covered_chars"] <= MAX_COVERED * out["word_chars"]) & (longest <= MAX_LONGEST)
    return out


def _measure(batches):
    types = {f.split()[0]: pa.bool_() if f.endswith("boolean") else pa.int64() for f in SCHEMA.split(", ")}
    for batch in batches:
        for chunk in tk.chunks(batch.column("text")):
            cols = measure(chunk)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.lo, chunk.n), *(pa.array(cols[c], types[c]) for c in list(types)[1:])], names=list(types))


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with the measures and the verdict ``kept``.

    Null and empty texts have no words and fail the base rule.  Null ids are
    returned as they are; repeated rows are measured each for itself; other
    columns are not looked at.  No shuffle.
    """
    return id_text(docs, id_col, text_col).mapInArrow(_measure, SCHEMA)


def keep_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep.  No shuffle.

    Null and empty texts fail the base rule and go.  Repeated rows are judged
    each for itself; an empty table stays empty; ids and other columns are not
    looked at.
    """
    importable(docs.sparkSession)

    def keep(batches):
        for batch in batches:
            for chunk in tk.chunks(batch.column(text_col)):
                yield batch.slice(chunk.lo, chunk.n).filter(pa.array(measure(chunk)["kept"]))
            tk.release()

    return docs.mapInArrow(keep, docs.schema)


def op2_repetition(spark, sf_dir: str) -> DataFrame:
    return repetition_rules(documents(spark, sf_dir))
