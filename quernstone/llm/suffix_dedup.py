"""Removal of repeated byte strings by deep-shallow suffix sorting.

A byte goes if it lies in a ``LENGTH``-byte string that also starts in a
document with a smaller id.  Only strings that can occur twice need sorting:

1. Each window of LENGTH bytes has a minimizer, its leftmost ``GRAM``-byte
   gram of least hash.  Equal windows have equal minimizers, so a window whose
   minimizer occurs in one document only can't repeat.  Buckets send the
   distinct hashes they have to the hashes' shards and get back the shared ones.
2. Runs of windows with one shared minimizer are sent, as bytes, to the
   minimizer's shard; runs of a bucket with the same bytes travel once, with
   the least and the largest id that have them.  So equal windows of the whole
   corpus meet in one shard, once a bucket.
3. The shard sorts the windows of all its distinct runs: a multikey quicksort
   on eight-byte characters down to the shallow depth, then blind tries for the
   groups still tied.  Equal windows are neighbours then, and the least id of
   their runs is theirs.  Back go, for each run of a bucket, the stretches of
   its windows and their least ids.
4. The bucket finds its runs again and deletes, in each document that has one,
   the windows whose least id is smaller.

Step 3 is exact on bytes, and so is the merging of equal runs; hashes only
decide what is sorted where.  Buckets follow the bytes of the texts, and a
passage of any number of documents is one entry a bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import buckets as bk
from quernstone.llm import textkernel as tk
from quernstone.llm.cluster import documents

LENGTH = 50
GRAM = 20
SHALLOW = 32
#: Shards of runs per bucket; a worker sorts one at a time.
SHARDS = 3
NO_ID = np.iinfo(np.int64).max

_U = np.uint64


def minimizer_runs(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first window, last window, minimizer hash, document, prefix hashes)`` of each run of windows with one minimizer."""
    n, width = len(buf), length - gram + 1
    none = np.zeros(0, np.int64)
    pre = tk.prefix_hash(buf)
    if n < length:
        return none, none, np.zeros(0, _U), none, pre
    _, down = tk.powers(n + 1)
    with np.errstate(over="ignore"):
        h = tk.mix((pre[gram:] - pre[:-gram]) * down[: n - gram + 1])
    shift = _U(max(24, int(n).bit_length()))
    low = (_U(1) << shift) - _U(1)
    key = (h & ~low) | np.arange(len(h), dtype=_U)
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    valid = np.zeros(n - length + 1, bool)
    sizes = np.diff(offs)
    long = sizes >= length
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, offs[:-1][long], 1)
    np.add.at(edge, offs[1:][long] - length + 1, -1)
    valid = np.cumsum(edge[: n - length + 1]) > 0
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, np.zeros(0, _U), none, pre
    place = (key[at] & low).astype(np.int64)
    doc = np.searchsorted(offs, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last], h[place[first]], doc[first], pre


class BlindTrie:
    """A Patricia trie over ``depth``-byte strings: inner nodes keep only where they branch.

    An insertion walks down without comparing skipped bytes, compares with the
    leaf it meets, and so learns the common prefix and the place to branch.
    """

    def __init__(self, text: bytes, depth: int, skip: int):
        self.text, self.depth, self.skip, self.root = text, depth, skip, None

    def insert(self, at: int) -> None:
        text, depth = self.text, self.depth
        if self.root is None:
            self.root = [depth, [at]]
            return
        node = self.root
        while node[0] < depth:
            kids = node[1]
            node = kids.get(text[at + node[0]]) or next(iter(kids.values()))
        a, b = text[at + self.skip : at + depth], text[(other := node[1][0]) + self.skip : other + depth]
        if a == b:
            node[1].append(at)
            return
        lcp = self.skip + next(k for k, (x, y) in enumerate(zip(a, b)) if x != y)
        parent, edge, node = None, None, self.root
        while node[0] < lcp:
            parent, edge = node, text[at + node[0]]
            node = node[1][edge]
        if node[0] == lcp and lcp < depth:
            node[1][text[at + lcp]] = [depth, [at]]
            return
        fresh = [lcp, {text[other + lcp]: node, text[at + lcp]: [depth, [at]]}]
        if parent is None:
            self.root = fresh
        else:
            parent[1][edge] = fresh

    def leaves(self):
        """Lists of equal strings, in order."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] == self.depth:
                yield node[1]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]


def _words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(buf)]).view(">u8").ravel().astype(_U)


def deep_shallow(buf: np.ndarray, starts: np.ndarray, depth: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the ``depth``-byte strings at ``starts``: ``(order, class)``.

    ``order`` indexes ``starts``; ``class`` numbers the distinct strings along
    it.  ``starts[i] + depth`` must not pass the end.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    char = _words_at(buf)
    order = np.argsort(char[starts])
    key = char[starts[order]]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    for level in range(8, min(shallow, depth - 7), 8):  # the multikey quicksort: tied groups by their next character
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(tied):
            break
        key, own = char[starts[order[tied]] + level], group[tied]
        by = np.argsort(key, kind="stable")
        by = by[np.argsort(own[by], kind="stable")]
        order[tied], key, own = order[tied][by], key[by], own[by]
        new[tied] = True
        new[tied[1:]] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)[group]
    tied = np.flatnonzero(np.bincount(group)[group] > 1)
    differs = np.zeros(n, bool)  # from the first of its group: a trie of one leaf settles the rest
    for level in [*range(min(shallow, depth - 8), depth - 8, 8), depth - 8]:
        differs[tied] |= char[starts[order[tied]] + level] != char[starts[order[head[tied]]] + level]
    deep = np.unique(group[differs])
    if len(deep):
        text = buf.tobytes()
        lo, size = np.flatnonzero(new), np.bincount(group)
        for g in deep.tolist():
            slots = slice(int(lo[g]), int(lo[g] + size[g]))
            trie, member = BlindTrie(text, depth, 0), {}
            for k, at in zip(order[slots].tolist(), starts[order[slots]].tolist()):
                member.setdefault(at, []).append(k)
            for at in member:
                trie.insert(at)
            k = slots.start
            for leaf in trie.leaves():
                own = [m for at in leaf for m in member[at]]
                order[k : k + len(own)] = own
                new[k] = True
                new[k + 1 : k + len(own)] = False
                k += len(own)
    return order, np.cumsum(new) - 1


def _texts(table: pa.Table):
    """``(ids, chunk)`` over a bucket; rows without an id count as empty."""
    ids = table.column("doc_id").fill_null(NO_ID).to_numpy()
    for chunk in tk.chunks(table.column("text")):
        yield ids, chunk


def _runs(table: pa.Table):
    for ids, chunk in _texts(table):
        first, last, h, doc, pre = minimizer_runs(chunk.buf, chunk.offs)
        named = ids[chunk.lo + doc] != NO_ID
        yield chunk, first[named], last[named], h[named], chunk.lo + doc[named], pre


def _all_runs(table: pa.Table):
    """All runs of a (canonical) bucket and the first of each set of runs with the same bytes.

    ``buf``: the bucket's bytes; ``begin``, ``size``: each run's place there;
    ``h``: its minimizer; ``row``; ``pos``: its place in the row; ``lead``: the
    first run with the same bytes.
    """
    buf, offs = tk.layout(table.column("text"))
    parts = [(h, tk.span_hash(pre, first, last + LENGTH), offs[chunk.lo] + first, last + LENGTH - first, row) for chunk, first, last, h, row, pre in _runs(table)]
    h, content, begin, size, row = (np.concatenate([np.zeros(0, t), *(p[k] for p in parts)]) for k, t in enumerate((_U, _U, np.int64, np.int64, np.int64)))
    return buf, begin, size, h, row, begin - offs[row], _equal_runs(buf, begin, size, content)


def _send_hashes(shards: int):
    """Bucket to shard: its distinct minimizers; those of two of its rows first."""

    def run(table: pa.Table) -> pa.Table:
        table = bk.canonical(table)
        bucket = table.column("bucket")[0].as_py()
        found = [(h, doc) for _, _, _, h, doc, _ in _runs(table)]
        h = np.concatenate([np.zeros(0, _U), *(x for x, _ in found)])
        doc = np.concatenate([np.zeros(0, np.int64), *(x for _, x in found)])
        by = np.argsort(h, kind="stable")
        h, doc = h[by], doc[by]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        many = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first) if len(h) else np.zeros(0, bool)
        h = np.concatenate([h[first][many], h[first][~many]])
        n_many = int(many.sum())
        order, at = bk.by_shard(h, shards)
        packed = bk.pack48(h[order])
        n = np.searchsorted(order[:0], 0)  # 0, for an empty bucket
        multi = np.add.reduceat(np.append(order < n_many, 0), np.minimum(at[:-1], len(order))) * (np.diff(at) > 0) if len(order) else np.full(shards, n)
        return pa.table({"shard": pa.array(np.arange(shards), pa.int32()), "bucket": pa.array([bucket] * shards, pa.int32()), "multi": pa.array(multi, pa.int32()), "hashes": pa.array([packed[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())})

    return run


def _shared_hashes(table: pa.Table) -> pa.Table:
    """Shard to buckets: those of a bucket's minimizers that two rows of the corpus have."""
    raw, counts = bk.joined(table.column("hashes"), "V6")
    h = bk.unpack48(raw.tobytes())
    rows = np.repeat(np.arange(table.num_rows), counts)
    within = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    many = within < np.repeat(table.column("multi").to_numpy(), counts)
    by = np.argsort(h, kind="stable")
    new = np.append(True, h[by][1:] != h[by][:-1]) if len(h) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    shared = (np.bincount(group) > 1) | (np.bincount(group, many[by]) > 0) if len(h) else np.zeros(0, bool)
    keep = np.zeros(len(h), bool)
    keep[by] = shared[group]
    h, n = h[keep], np.bincount(rows[keep], minlength=table.num_rows)
    packed, at = bk.pack48(h), np.append(0, np.cumsum(n))
    return pa.table({"bucket": table.column("bucket"), "shard": table.column("shard"), "hashes": pa.array([packed[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())})


RUNS = "shard int, bucket int, number binary, size binary, data binary, least binary, most binary"
MARKS = "bucket int, number binary, first binary, after binary, least binary"


def _equal_runs(data: np.ndarray, begin: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each run the first run of the same bytes (hashes propose, the bytes decide)."""
    by = np.lexsort((np.arange(len(h)), h))
    head = np.append(True, h[by][1:] != h[by][:-1]) if len(by) else np.zeros(0, bool)
    first = np.empty(len(h), np.int64)
    first[by] = by[np.flatnonzero(head)][np.cumsum(head) - 1]
    wrong = size != size[first]
    other = np.flatnonzero((first != np.arange(len(h))) & ~wrong)
    for lo in range(0, len(other), 1 << 15):
        k = other[lo : lo + (1 << 15)]
        differ = data[tk.ragged(begin[k], size[k])] != data[tk.ragged(begin[first[k]], size[k])]
        wrong[k] = np.add.reduceat(differ, np.cumsum(size[k]) - size[k]) > 0
    first[wrong] = np.flatnonzero(wrong)
    return first


def _send_runs(shards: int):
    """Bucket to shard: the distinct runs of windows with shared minimizers, and the least and largest id that have each."""

    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.split()[0]: [] for f in RUNS.split(", ")}
        if table.num_rows and shared.num_rows:
            table = bk.canonical(table)
            bucket, ids = table.column("bucket")[0].as_py(), table.column("doc_id").fill_null(NO_ID).to_numpy()
            low = np.sort(bk.unpack48(bk.joined(shared.column("hashes"), "V6")[0].tobytes()))
            buf, begin, size, h, row, _, lead = _all_runs(table)
            h48 = h & _U((1 << 48) - 1)
            at = np.searchsorted(low, h48)
            at[at == len(low)] = 0
            least, most = np.full(len(h), NO_ID), np.full(len(h), -NO_ID - 1)
            np.minimum.at(least, lead, ids[row])
            np.maximum.at(most, lead, ids[row])
            sent = np.flatnonzero((low[at] == h48) & (lead == np.arange(len(h)))) if len(low) else np.zeros(0, np.int64)
            order, cuts = bk.by_shard(h[sent], shards)
            for s in range(shards):
                r = sent[order[cuts[s] : cuts[s + 1]]]
                if len(r):
                    for name, v in zip(out, (s, bucket, r.astype(np.int32), size[r].astype(np.uint8), buf[tk.ragged(begin[r], size[r])], least[r], most[r])):
                        out[name].append(v.tobytes() if isinstance(v, np.ndarray) else v)
        return pa.table({name: pa.array(v, pa.int32() if name in ("shard", "bucket") else pa.binary()) for name, v in out.items()})

    return run


def _mark(table: pa.Table) -> pa.Table:
    """Shard to buckets: the least id of each window of their runs, by stretches; only where it can delete something."""
    size, per_bucket = bk.joined(table.column("size"), np.uint8)
    size = size.astype(np.int64)
    data, _ = bk.joined(table.column("data"), np.uint8)
    number, _ = bk.joined(table.column("number"), np.int32)
    least_id, most_id = (bk.joined(table.column(c), np.int64)[0] for c in ("least", "most"))
    begin = np.cumsum(size) - size
    first = _equal_runs(data, begin, size, tk.span_hash(tk.prefix_hash(data), begin, begin + size))
    least_run = np.full(len(size), NO_ID)
    np.minimum.at(least_run, first, least_id)
    lead = np.flatnonzero(first == np.arange(len(size)))
    n_win = np.zeros(len(size), np.int64)
    n_win[lead] = size[lead] - LENGTH + 1
    first_win = np.cumsum(n_win) - n_win
    least = np.empty(int(n_win.sum()), np.int64)
    order, cls = deep_shallow(data, tk.ragged(begin, n_win))
    if len(cls):
        run_of = np.repeat(least_run, n_win)
        least[order] = np.minimum.reduceat(run_of[order], np.flatnonzero(np.append(True, cls[1:] != cls[:-1])))[cls]
    del order, cls
    # stretches of windows of one run with one least id
    of = np.repeat(np.arange(len(size)), n_win)
    head = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (least[1:] != least[:-1]))) if len(of) else np.zeros(0, np.int64)
    tail, own = np.append(head[1:], len(of)), of[head]
    ptr = np.searchsorted(own, np.arange(len(size) + 1))
    s_lo, s_hi, s_id = head - first_win[own], tail - first_win[own], least[head]
    n = np.diff(ptr)[first]
    each, stretch = np.repeat(np.arange(len(size)), n), tk.ragged(ptr[first], n)
    some = s_id[stretch] < most_id[each]
    each, stretch = each[some], stretch[some]
    at = np.searchsorted(each, np.append(0, np.cumsum(per_bucket)))
    values = number[each], s_lo[stretch].astype(np.uint8), s_hi[stretch].astype(np.uint8), s_id[stretch]
    rows = [k for k in range(table.num_rows) if at[k] < at[k + 1]]
    packed = [pa.array([v[at[k] : at[k + 1]].tobytes() for k in rows], pa.binary()) for v in values]
    return pa.table([table.column("bucket").take(pa.array(rows, pa.int64())), *packed], names=[f.split()[0] for f in MARKS.split(", ")])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary, kept_text binary"


def _spans(table: pa.Table, marks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, start, end)`` of the bytes to delete, by row."""
    number, first, after, least = (bk.joined(marks.column(c), t)[0] for c, t in (("number", np.int32), ("first", np.uint8), ("after", np.uint8), ("least", np.int64)))
    if not len(number) or not table.num_rows:
        return (np.zeros(0, np.int64),) * 3
    ids = table.column("doc_id").fill_null(NO_ID).to_numpy()
    _, _, _, _, row, pos, lead = _all_runs(table)
    by = np.argsort(number, kind="stable")
    number, first, after, least = number[by], first[by].astype(np.int64), after[by].astype(np.int64), least[by]
    lo = np.searchsorted(number, lead)
    n = np.searchsorted(number, lead, "right") - lo
    run, k = np.repeat(np.arange(len(lead)), n), tk.ragged(lo, n)
    goes = least[k] < ids[row[run]]
    run, k = run[goes], k[goes]
    return row[run], pos[run] + first[k], pos[run] + after[k] - 1 + LENGTH


def _apply(with_text: bool):
    def run(table: pa.Table, marks: pa.Table) -> pa.Table:
        if table.num_rows:
            table = bk.canonical(table)
        r, s, e = _spans(table, marks)
        by = np.argsort(r, kind="stable")
        r, s, e = r[by], s[by], e[by]
        at = np.searchsorted(r, np.arange(table.num_rows + 1))
        cols: dict[str, list] = {f.split()[0]: [] for f in RESULT.split(", ")[1:]}
        for _, chunk in _texts(table):
            for k in range(chunk.n):
                row, text = chunk.lo + k, chunk.text(k)
                a, b = tk.merge_spans(s[at[row] : at[row + 1]], e[at[row] : at[row + 1]])
                if len(a):
                    edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(text)]
                    kept = b"".join(text[i:j] for i, j in zip(edges[0::2], edges[1::2]))
                else:
                    kept = text
                for name, v in zip(cols, (len(text), len(text) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), np.stack([a, b], 1).astype(np.int64).tobytes() if with_text else None, kept if with_text else None)):
                    cols[name].append(v)
        types = {"kept_sha256": pa.string(), "spans": pa.binary(), "kept_text": pa.binary()}
        return pa.table({"doc_id": table.column("doc_id"), **{c: pa.array(v, types.get(c, pa.int64())) for c, v in cols.items()}})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``, with the columns of :data:`RESULT`.

    ``spans``: the removed runs as pairs of int64 byte offsets; ``kept_text``:
    the remaining bytes, which need not be whole characters (both null unless
    ``with_text``).  Texts are judged as they came in.  A null text is empty.
    A row with a null id has no smaller or larger neighbours and stays whole.
    Rows with one id do not remove each other.  An empty table gives no rows.
    Other columns are not looked at.
    """
    n = bk.buckets_for(docs, text_col)
    dealt = bk.bucketed(docs, n, id_col, text_col)
    hashes = dealt.groupBy("bucket").applyInArrow(_send_hashes(n), "shard int, bucket int, multi int, hashes binary")
    shared = hashes.filter(F.length("hashes") > 0).groupBy("shard").applyInArrow(_shared_hashes, "bucket int, shard int, hashes binary")
    runs = dealt.groupBy("bucket").cogroup(shared.filter(F.length("hashes") > 0).groupBy("bucket")).applyInArrow(_send_runs(SHARDS * n), RUNS)
    marks = runs.groupBy("shard").applyInArrow(_mark, MARKS)
    return dealt.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(_apply(with_text), RESULT)


def op4_deep_shallow(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
