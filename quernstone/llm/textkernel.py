"""Vectorised byte-level text primitives shared by the operators.

Every function works on a :class:`Chunk`: the UTF-8 bytes of a run of whole
documents laid end to end, with the offset of each.  Word boundaries, word
hashes and shingle hashes are computed for a whole chunk at once in numpy;
nothing loops over words.  Chunks hold about ``CHUNK_BYTES`` of text, or one
document where that is longer, so the memory of a worker is bounded by the
longest document and not by the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def _class(chars) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Bytes of a word `[^\x20\x09-\x0D]+`.
SPACE_WORDS = ~_class([0x20, *range(0x09, 0x0E)])
#: Bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing).
ALNUM_WORDS = ~_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: A-Z to a-z, everything else itself.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@dataclass
class Chunk:
    """Rows ``lo:hi`` of a batch: their bytes and the n + 1 offsets of the texts."""

    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()


def layout(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Splits a text column at document boundaries into chunks of about ``limit`` bytes."""
    buf, offs = layout(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i < n, kept between calls."""
    if len(_powers.get("up", ())) < n:
        with np.errstate(over="ignore"):
            size = max(n, CHUNK_BYTES + 4096)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                steps = np.full(size, base, _U)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums from which :func:`span_hash` reads the hash of any span."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum((buf.astype(_U) + _U(1)) * up[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        raw = (prefix[ends] - prefix[starts]) * down[starts]
        return mix(raw + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Word spans of a chunk; words of document i are ``ptr[i]:ptr[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)


def spans_of(flags: np.ndarray, offs: np.ndarray) -> Words:
    """Maximal runs of set flags that do not cross document boundaries."""
    n = len(flags)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offs), np.int64))
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, flags[:-1]
    after[-1], after[:-1] = False, flags[1:]
    before[offs[:-1][offs[:-1] < n]] = False
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(flags & ~before)
    ends = np.flatnonzero(flags & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offs))


def words(chunk: Chunk, lower: bool = False, keep: np.ndarray = SPACE_WORDS) -> tuple[Words, np.ndarray]:
    """Word spans of a chunk and their 64-bit hashes."""
    buf = LOWER[chunk.buf] if lower else chunk.buf
    spans = spans_of(keep[buf], chunk.offs)
    return spans, span_hash(prefix_hash(buf), spans.starts, spans.ends)


def window_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``hashes[i:i + width]`` for each i that has so many."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _U(0xA0761D6478BD642F) + hashes[k : k + n]
    return mix(out)


def sequence_hash(hashes: np.ndarray) -> int:
    """One hash for a whole (short) sequence."""
    return int(window_hash(hashes, len(hashes))[0]) if len(hashes) else 0


def shingle_set(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct ``width``-word shingles of one document's word hashes.

    Fewer words than ``width`` make one shingle of them all; no words make none.
    """
    if not len(hashes):
        return np.zeros(0, _U)
    return np.unique(window_hash(hashes, min(width, len(hashes))))


def shingle_sets(column, width: int = 5) -> Iterator[np.ndarray]:
    """The shingle set of each text of a column, in order, lower-cased."""
    for chunk in chunks(column):
        spans, h = words(chunk, lower=True)
        for a, b in zip(spans.ptr[:-1].tolist(), spans.ptr[1:].tolist()):
            yield shingle_set(h[a:b], width)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i]`` of all i, laid end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)


def code_points(buf: np.ndarray) -> np.ndarray:
    """n + 1 counts of the code points that begin before each byte."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def binaries(parts: list[np.ndarray]) -> pa.Array:
    """A binary column of the arrays' bytes."""
    return pa.array([p.tobytes() for p in parts], pa.binary())


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as sorted maximal runs (touching ones join)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s)) - 1]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _trim = None


def release() -> None:
    """Gives memory held for reuse back to the system: workers sit idle between stages beside busy ones."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
