"""Line dedup by pairwise alignment.

A document's lines are known by the hash of their stripped bytes; blank lines
have none.  Its keys are the shortest runs of consecutive lines that reach
``MIN_WORDS`` words, from each line on and up to each line: a long line is one
by itself.  A key that two documents have or more is shared.  A document's
partners are the earliest documents of its shared keys: however many documents
have a passage, each of them meets its first occurrence and no other.

Each pair of line sequences is aligned by patience diff: lines that both have
once, in longest increasing order, are fixed points, runs of equal lines grow
from them, and the gaps are aligned the same way.  Aligned blocks of
``MIN_WORDS`` words or more are deleted from the document with the larger id.
A shared key that stands in another order, or between lines that repeat, can be
left out by an alignment; it is a fixed point of its own then, and its lines go
too.  So the outcome is exact: a line goes if and only if it lies in a run of
consecutive lines of ``MIN_WORDS`` words or more that also stands in a document
with a smaller id.  (Any such run is covered by its keys, and the first
occurrence of each has a smaller id, too.)

Only hashes travel until then; the texts are shuffled once, to delete from.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import textkernel as tk
from quernstone.llm.cluster import cut, documents, id_text, named_again, numbered
from quernstone.llm.components import join_anew

MIN_WORDS = 10


def _stripped(chunk: tk.Chunk):
    """``(lines, words in each, hash of each without outer white space)``; only lines with words."""
    lines = tk.spans_of(chunk.buf != 10, chunk.offs)
    words = tk.spans_of(tk.SPACE_WORDS[chunk.buf], chunk.offs)
    lo, hi = np.searchsorted(words.starts, lines.starts), np.searchsorted(words.starts, lines.ends)
    some = hi > lo
    pre = tk.prefix_hash(chunk.buf)
    h = tk.span_hash(pre, words.starts[lo[some]], words.ends[hi[some] - 1])
    starts = lines.starts[some]
    return np.searchsorted(starts, chunk.offs), (hi - lo)[some], h


def run_keys(ptr: np.ndarray, n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(document, first line, line after the last, hash)`` of the shortest runs with ``MIN_WORDS`` words, from each line on and up to each line."""
    doc, total, every = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), np.append(0, np.cumsum(n)), np.arange(len(n))
    lo = np.concatenate([every, np.searchsorted(total, total[1:] - MIN_WORDS, "right") - 1])
    hi = np.concatenate([np.searchsorted(total, total[:-1] + MIN_WORDS), every + 1])
    doc = np.concatenate([doc, doc])
    fits = (lo >= ptr[doc]) & (hi <= ptr[doc + 1])
    fits[len(every) :] &= hi[lo[len(every) :]] != hi[len(every) :]  # found from its first line on already
    order = np.argsort(doc[fits], kind="stable")
    lo, hi, doc = lo[fits][order], hi[fits][order], doc[fits][order]
    key = np.full(len(lo), 1, np.uint64)
    for k in range(MIN_WORDS):  # a line has a word at least
        on = lo + k < hi
        key[on] = tk.mix(key[on] * np.uint64(0x9E3779B97F4A7C15) + h[lo[on] + k])
    return doc, lo, hi, key


def _sequences(batches):
    """Rows (doc_id, fp, lines, n_words, runs): the hashes of a text's lines, their numbers of words, its keys."""
    for batch in batches:
        for chunk in tk.chunks(batch.column("text")):
            ptr, n, h = _stripped(chunk)
            part, offs = batch.slice(chunk.lo, chunk.n), pa.array(ptr.astype(np.int32))
            doc, _, _, runs = run_keys(ptr, n, h)
            columns = [part.column("doc_id"), part.column("fp"), *(pa.ListArray.from_arrays(offs, pa.array(x)) for x in (h.view(np.int64), n.astype(np.int64)))]
            columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(chunk.n + 1)).astype(np.int32)), pa.array(runs.view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "lines", "n_words", "runs"])
        tk.release()


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops, piles, back = [], [], [0] * len(values)
    for k, v in enumerate(values):
        p = bisect_left(tops, v)
        if p == len(tops):
            tops.append(v)
            piles.append(k)
        else:
            tops[p], piles[p] = v, k
        back[k] = piles[p - 1] if p else -1
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned index pairs of two sequences, increasing in both."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        n_a, n_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {x: k for k, x in enumerate(b[b0:b1], b0) if n_b[x] == 1}
        unique = [(k, at_b[x]) for k, x in enumerate(a[a0:a1], a0) if n_a[x] == 1 and x in at_b]
        if not unique:
            continue
        fixed = [unique[k] for k in longest_increasing([j for _, j in unique])]
        out += fixed
        for (i, j), (i2, j2) in zip([(a0 - 1, b0 - 1), *fixed], [*fixed, (a1, b1)]):
            work.append((i + 1, i2, j + 1, j2))
    return sorted(out)


def common_blocks(later: list, earlier: list, n_words: list[int], least: int = MIN_WORDS) -> list[int]:
    """Indices of ``later`` under aligned blocks of ``least`` words or more."""
    out, block, last = [], [], None
    for i, j in [*patience(later, earlier), (None, None)]:
        if block and i is not None and (i, j) == (last[0] + 1, last[1] + 1):
            block.append(i)
        else:
            if sum(n_words[k] for k in block) >= least:
                out += block
            block = [i]
        last = (i, j)
        if i is None:
            break
    return out


def shared_runs(later: np.ndarray, earlier: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Which lines of ``later`` lie in a key that ``earlier`` has too."""
    order = np.argsort(later, kind="stable")
    at = np.searchsorted(later[order], earlier)
    at[at == len(later)] = 0
    known = later[order][at] == earlier  # lines that only the earlier one has break its runs
    limits = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]])))
    pieces = limits[0::2], limits[1::2]
    ptr = np.append(0, np.cumsum(pieces[1] - pieces[0]))
    _, _, _, theirs = run_keys(ptr, n_words[order][at][known], earlier[known].view(np.uint64))
    _, lo, hi, own = run_keys(np.array([0, len(later)]), n_words, later.view(np.uint64))
    edge = np.zeros(len(later) + 1, np.int64)
    both = np.isin(own, theirs)
    np.add.at(edge, lo[both], 1)
    np.add.at(edge, hi[both], -1)
    return np.cumsum(edge[:-1]) > 0


def lines_to_delete(later: np.ndarray, earlier: np.ndarray, n_words: np.ndarray) -> list[int]:
    """Indices of ``later`` under aligned blocks, and under shared keys that the alignment left out."""
    gone = np.zeros(len(later), bool)
    if np.array_equal(later, earlier):  # a copy: all of it is one block
        gone[:] = n_words.sum() >= MIN_WORDS
    else:
        own, other = later.tolist(), earlier.tolist()
        aligned = common_blocks(own, other, n_words.tolist())
        gone[aligned] = True
        both = set(other)
        left = [k for k, x in enumerate(own) if x in both and not gone[k]]
        if left and n_words[left].sum() + n_words[aligned].sum() >= MIN_WORDS:
            gone |= shared_runs(later, earlier, n_words)
    return np.flatnonzero(gone)


def _align(batches):
    """Pairs one by one: a worker holds one pair's lines beside the batch."""
    for batch in batches:
        later, earlier, n_words = (batch.column(c) for c in ("lines", "earlier", "n_words"))
        gone = []
        for k in range(batch.num_rows):
            a, b, n = (x[k].values.to_numpy(zero_copy_only=False) for x in (later, earlier, n_words))
            gone.append(lines_to_delete(a, b, n))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fp"), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "fp", "gone"])


def without_lines(text: bytes, gone) -> tuple[bytes, int]:
    """``text`` without the lines of the numbers ``gone``, counting lines with words; and how many lines it had."""
    lines = text.split(b"\n") if text else []
    if gone:
        drop, seen, kept = set(gone), -1, []
        for line in lines:
            some = bool(line.strip(b" \t\n\r\x0b\x0c"))
            seen += some
            if not (some and seen in drop):
                kept.append(line)
        text = b"\n".join(kept)
    return text, len(lines)


def _delete(text_col: str):
    """Replaces the text column and fills ``n_lines`` and ``n_removed``."""

    def run(batches):
        for batch in batches:
            for chunk in tk.chunks(batch.column(text_col)):
                part = batch.slice(chunk.lo, chunk.n)
                gone, n_lines, texts = part.column("gone").to_pylist(), [], []
                for k in range(chunk.n):
                    text, n = without_lines(chunk.text(k), gone[k])
                    n_lines.append(n)
                    texts.append(text)
                new = {text_col: pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_removed": pa.array([len(g or ()) for g in gone], pa.int64())}
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in part.schema.names], names=part.schema.names)
            tk.release()

    return run


def _lines_gone(docs: DataFrame) -> DataFrame:
    """``(id, fp, gone)`` of the texts of ``docs(doc_id, text, fp)`` that lose lines."""
    rows = cut(docs.filter("doc_id is not null and text is not null").mapInArrow(_sequences, "doc_id long, fp long, lines array<bigint>, n_words array<bigint>, runs array<bigint>").filter(F.size("runs") > 0))
    keys = rows.select("doc_id", F.explode(F.array_distinct("runs")).alias("key")).distinct()
    shared = keys.groupBy("key").agg(F.count("*").alias("df"), F.min("doc_id").alias("first")).filter("df > 1").select("key", "first")
    partners = join_anew(keys, shared, "key").filter("first < doc_id").select("doc_id", "first").distinct()
    earlier = rows.select(F.col("doc_id").alias("first"), F.col("lines").alias("earlier"))
    pairs = partners.join(rows.drop("runs"), "doc_id").join(earlier, "first").select("doc_id", "fp", "lines", "n_words", "earlier")
    gone = pairs.mapInArrow(_align, "doc_id long, fp long, gone array<int>").filter(F.size("gone") > 0)
    return gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("fp").alias("gone_fp")).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def _apply(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rows`` with the text column cut, and ``n_lines`` and ``n_removed``."""
    text = F.col(text_col).cast("string")
    marked = rows.withColumns({text_col: text, "id": F.col(id_col).cast("long"), "fp": F.xxhash64(text)})
    gone = _lines_gone(marked.select(F.col("id").alias("doc_id"), F.col(text_col).alias("text"), "fp"))
    joined = marked.join(gone, F.expr("id = gone_id and fp = gone_fp"), "left").drop("id", "fp", "gone_id", "gone_fp")
    joined = joined.withColumns({"n_lines": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")})
    return joined.mapInArrow(_delete(text_col), joined.schema)


def align_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_removed, text`` (what is left).

    All deletions are decided on the input.  Null and empty texts have no
    lines; what is left of a null is empty.  A null id is neither earlier nor
    later than others: its text stays whole.  Rows with one id are not aligned
    with each other, and each gets the deletions of its own text.  Other
    columns are not looked at.  An empty table gives no rows.
    """
    return _apply(id_text(docs, id_col, text_col), "doc_id", "text").select("doc_id", "n_lines", "n_removed", "text")


def align_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and what :func:`align_lines` leaves of the texts.

    Nulls, empty texts and tables, and repeated rows are as there; a null text
    comes back empty.
    """
    rows, names = numbered(docs)
    return named_again(_apply(rows, names[id_col], names[text_col]), names)


def op6_line_alignment(spark, sf_dir: str) -> DataFrame:
    return align_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: A line goes if it lies in one of the shortest runs of lines with ten words that a document with a smaller id has, too.
OP6_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND text <> ''),
u AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM l),
w AS (SELECT doc_id, pos, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM u),
s AS (SELECT doc_id, line, pos, n, row_number() OVER o AS k, sum(n) OVER o AS upto FROM w WHERE n > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
a AS (SELECT doc_id, list(line ORDER BY k) AS ls FROM s GROUP BY doc_id),
r AS (SELECT x.doc_id, x.k AS lo, y.k AS hi FROM s x JOIN s y ON x.doc_id = y.doc_id AND y.k BETWEEN x.k AND x.k + 9
  WHERE y.upto - x.upto + x.n >= 10 AND (y.upto - x.upto < 10 OR y.upto - y.n - x.upto + x.n < 10)),
k AS (SELECT doc_id, lo, hi, array_to_string(ls[lo:hi], chr(10)) AS key FROM r JOIN a USING (doc_id)),
f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key),
g AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS k FROM k JOIN f USING (key) WHERE first < doc_id),
gone AS (SELECT s.doc_id, s.pos FROM s JOIN g ON g.doc_id = s.doc_id AND g.k = s.k),
kept AS (SELECT u.doc_id, string_agg(u.line, chr(10) ORDER BY u.pos) AS text FROM u ANTI JOIN gone ON gone.doc_id = u.doc_id AND gone.pos = u.pos GROUP BY u.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
