"""Exchange between documents and corpus-wide keys in packed form.

Documents are dealt into buckets by a hash of their id and text.  What a bucket knows
about a key (a word, a line, a minimizer) is combined inside the bucket first
and then sent to the key's shard as packed arrays, one row per bucket and
shard; the shard's answer goes back to the buckets the same way.  A key that
a third of all documents have thus arrives at its shard once per bucket, not
once per document, and nothing is broadcast or collected.

The exchange of the documents is the same plan node wherever it is used in a
query, so Spark writes those shuffle files once and reuses them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import textkernel as tk
from quernstone.llm.cluster import id_text

#: Text of a bucket; a worker holds one at a time.
BUCKET_BYTES = 8 << 20


def buckets_for(docs: DataFrame, text_col: str = "text", size: int = BUCKET_BYTES) -> int:
    """How many buckets of about ``size`` bytes the texts fill.  A function of the table alone."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0]
    return max(1, -(-(total or 0) // size))


def bucketed(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bucket, doc_id, text``: the bucket is a function of id and text, so that an id with many rows isn't one bucket."""
    docs = id_text(docs, id_col, text_col)
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"), "doc_id", "text")


def canonical(table: pa.Table) -> pa.Table:
    """The bucket's rows by id, then text, so that row numbers are the same each time it is computed."""
    ids = table.column("doc_id")
    order = np.argsort(ids.fill_null(np.iinfo(np.int64).min).to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    ids = table.column("doc_id").to_pylist()
    if len(set(ids)) < len(ids):
        texts = table.column("text").to_pylist()
        table = table.take(pa.array(sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, texts[k] is not None, texts[k] or ""))))
    return table


def by_shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of keys by shard, and the ``shards + 1`` limits in it."""
    shard = (hashes % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def pack48(hashes: np.ndarray) -> np.ndarray:
    """The low six bytes of each hash."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def unpack48(data: bytes | np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel().astype(np.uint64)


def joined(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All arrays of a binary column end to end, and how many items each row has."""
    buf, offs = tk.layout(column)
    item = np.dtype(dtype).itemsize
    return np.frombuffer(buf.tobytes(), dtype), np.diff(offs) // item
