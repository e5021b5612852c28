"""MinHash near-dedup on bottom-k sketches of one hash function.

1. Each text becomes its set of distinct five-word shingles; one pass keeps a
   128-bit digest of the set and its ``SKETCH`` smallest hashes (the bottom-k
   sketch).  Equal sets form a class, represented by its smallest id, so a
   group of any number of copies is one row from here on.
2. Inverted lists over the retained values.  Of a document's values only its
   rarest ``prefix`` take part (see :func:`prefix_length`): two sets at the
   threshold share so many retained values that one of the shared ones is
   among the rarest of both, so values that many documents have cost nothing
   unless a document consists of little else.
   The place of a value among a small set's bounds how much two sets can share
   from there on, and so the sizes of partners (see ``most`` below).
3. Overlaps are generated star-wise: in each list every document meets a
   pivot, over a few rounds with different pivots, and only while the two are
   not known to be connected.  The sketch of the union estimates the similarity
   and drops pairs far below the threshold; the exact Jaccard coefficient of
   the full shingle sets decides.
4. What the stars have not settled is compared in full: all pairs of a list's
   documents in different components, by counting the shingles that blocks of
   full sets have in common.  A block is bounded in shingles and in documents,
   and each pair of blocks is a row of its own.  Lists that begin with one
   document go together.  There is no cap, and only confirmed links come out,
   as many as it takes to join the components of two blocks.
5. Connected components of the confirmed links, and of the rows that repeat an
   id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm import buckets as bk
from quernstone.llm import textkernel as tk
from quernstone.llm.cluster import cut, documents, id_text
from quernstone.llm.components import connected_components, join_anew, quick_labels

SKETCH = 64
#: Shared values expected of two sketches at similarity 0.75 are 48 or more (sd 3.5); 30 is five sd below.
SHARED = 30
PIVOT_ROUNDS = 2
#: Shingles of a block, and its documents (about: they are dealt by hash).
BLOCK, BLOCK_DOCS = 200_000, 2000
#: Places of shingle pairs counted at once.
COUNTED = 1 << 21
WORD_SHINGLE = 5
NUM, DEN = 75, 100
#: Sets travel as the low 48 bits of their hashes.
LOW48 = np.uint64((1 << 48) - 1)


def prefix_length(n: int, sketch: int = SKETCH) -> int:
    """How many of a set's rarest retained values take part in the lists.

    A set that its sketch (and that of any partner) holds entirely needs
    n - ceil(0.75 n) + 1, which is exact.  Larger ones share ``SHARED``
    retained values with a partner but with probability under 1e-6 at the
    threshold itself, and far less above it.
    """
    if n <= sketch * NUM // DEN:
        return n - (NUM * n + DEN - 1) // DEN + 1
    return min(n, sketch) - SHARED + 1


def _sketches(sketch: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            ns, hi, lo, sketches = [], [], [], []
            for s in tk.shingle_sets(batch.column("text"), WORD_SHINGLE):
                ns.append(len(s))
                with np.errstate(over="ignore"):
                    hi.append(tk.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                    lo.append(tk.mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64))
                sketches.append(s[:sketch])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(ns, pa.int64()), pa.array(np.array(hi, np.uint64).view(np.int64)), pa.array(np.array(lo, np.uint64).view(np.int64)), tk.binaries(sketches)],
                names=["doc_id", "n", "fp_hi", "fp_lo", "sketch"],
            )
            tk.release()

    return run


def _values(batches):
    """Rows (v, id, n, own): each retained value of each class; own: how many it has."""
    for batch in batches:
        buf, offs = tk.layout(batch.column("sketch"))
        counts = np.diff(offs) // 8
        values = np.frombuffer(buf.tobytes(), np.int64)
        ids, ns = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), counts) for c in ("id", "n"))
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(ids), pa.array(ns)], names=["v", "id", "n"])


def _full_sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), tk.binaries([bk.pack48(np.unique(s & LOW48)) for s in tk.shingle_sets(batch.column("text"), WORD_SHINGLE)])], names=["id", "full"])


def _with_digest(batches):
    for batch in batches:
        lo = []
        for s in tk.shingle_sets(batch.column("text"), WORD_SHINGLE):
            with np.errstate(over="ignore"):
                lo.append(tk.mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(np.array(lo, np.uint64).view(np.int64))], names=["doc_id", "text", "fp_lo"])


def estimate_passes(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, sketch: int = SKETCH) -> bool:
    """Whether the sketch of the union (``a``, ``b``: the sets' sketches) leaves a similarity of 0.75 possible."""
    if DEN * min(n_a, n_b) < NUM * max(n_a, n_b):
        return False
    if n_a <= sketch and n_b <= sketch:
        return True
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    union = np.append(True, ~twice)
    last = both[union][:sketch][-1]
    return int((twice & (both[1:] <= last)).sum()) >= SHARED


def _verify(sketch: int):
    """Keeps the pairs whose full sets have 100 * intersection >= 75 * union."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column("full_a"), batch.column("full_b"))):
                a, b = bk.unpack48(a.as_py()), bk.unpack48(b.as_py())
                if not estimate_passes(a[:sketch], b[:sketch], len(a), len(b), sketch):
                    continue
                both = np.sort(np.concatenate([a, b]))
                both = int((both[1:] == both[:-1]).sum())
                keep[i] = DEN * both >= NUM * (len(a) + len(b) - both) and both > 0
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, sketch: int) -> DataFrame:
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("full").alias("full_a")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("full").alias("full_b")), "b")
    return with_b.select("a", "b", "full_a", "full_b").mapInArrow(_verify(sketch), "a long, b long")


def _unite(parent: dict, a: int, b: int) -> bool:
    for x in (a, b):
        parent.setdefault(x, x)
    while parent[a] != a:
        a = parent[a] = parent[parent[a]]
    while parent[b] != b:
        b = parent[b] = parent[parent[b]]
    parent[max(a, b)] = min(a, b)
    return a != b


def intersections(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two blocks' sets of distinct values.

    A value that few documents have adds its pairs one by one; one that many
    have is a column of two incidence matrices, of which a slice at a time is
    multiplied.  Memory is bounded by the documents of a block.
    """
    n_a, n_b = len(sets_a), len(sets_b)
    both = np.zeros((n_a, n_b), np.float32)
    sides = []
    for sets in (sets_a, sets_b):
        values = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(values, kind="stable")
        sides.append((values[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]))
    common = np.intersect1d(sides[0][0], sides[1][0])
    (lo_a, c_a), (lo_b, c_b) = ((lo := np.searchsorted(v, common), np.searchsorted(v, common, "right") - lo) for v, _ in sides)
    pairs = c_a * c_b
    many = pairs > max(64, n_a * n_b // 50)
    few = np.flatnonzero(~many)
    step = np.cumsum(pairs[few]) // COUNTED
    for part in np.split(few, np.flatnonzero(np.diff(step)) + 1):
        if len(part):
            own = np.repeat(part, c_a[part])  # each place of a, then all places of b
            rows_a = np.repeat(sides[0][1][tk.ragged(lo_a[part], c_a[part])], c_b[own])
            rows_b = sides[1][1][tk.ragged(lo_b[own], c_b[own])]
            both += np.bincount(rows_a * n_b + rows_b, minlength=n_a * n_b).reshape(n_a, n_b)
    hot = np.flatnonzero(many)
    for at in range(0, len(hot), 1024):
        part, hit = hot[at : at + 1024], []
        for (_, of), lo, c, n in ((sides[0], lo_a, c_a, n_a), (sides[1], lo_b, c_b, n_b)):
            m = np.zeros((n, len(part)), np.float32)
            m[of[tk.ragged(lo[part], c[part])], np.repeat(np.arange(len(part)), c[part])] = 1
            hit.append(m)
        both += hit[0] @ hit[1].T
    return both


def _block_links(batches):
    """Confirmed links between two blocks' documents: as many as it takes to join their components."""
    for batch in batches:
        out_a, out_b = [], []
        for at in range(batch.num_rows):
            sides = []
            for s in ("x", "y"):
                members = batch.column(s)[at].values
                ids, comps = (members.field(c).to_numpy(zero_copy_only=False) for c in ("id", "comp"))
                order = np.argsort(ids)
                full = members.field("full")
                sides.append((ids[order], comps[order], [bk.unpack48(full[k].as_py()) for k in order.tolist()]))
            (ids_a, c_a, full_a), (ids_b, c_b, full_b) = sides
            n_a, n_b = (np.array([len(f) for f in x], np.int64) for x in (full_a, full_b))
            both = intersections(full_a, full_b)
            linked = (both > 0) & (DEN * both >= NUM * (n_a[:, None] + n_b[None, :] - both)) & (c_a[:, None] != c_b[None, :])
            parent: dict[int, int] = {}
            for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
                if _unite(parent, int(c_a[i]), int(c_b[j])):
                    out_a.append(ids_a[i])
                    out_b.append(ids_b[j])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_a, out_b)], names=["a", "b"])


def _with_sums(rows: DataFrame, keys: list[str], **sums) -> DataFrame:
    """``rows`` with aggregates over ``keys``, joined on a hash besides.

    The hash makes Spark shuffle both sides of the join anew instead of keeping
    the aggregate's partitioning, and such joins it can split where a key is
    hot; a window or the bare join would bring the key's rows to one task.
    """
    of = F.xxhash64(*keys)
    found = rows.groupBy(*keys).agg(*(a.alias(c) for c, a in sums.items())).withColumn("__k", of)
    return rows.withColumn("__k", of).join(found, ["__k", *keys]).drop("__k")


def _between_blocks(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the rows ``(g, id, n, most, comp)`` of each group, between different components.

    Blocks hold ``BLOCK`` shingles and ``BLOCK_DOCS`` documents or so: large
    components have blocks of their own, small ones are dealt together.  The
    pairs of a group's blocks are found among a few numbers a block; the sets
    come to each pair on their own.
    """
    weighed = groups.withColumn("w", F.greatest("n", F.lit(BLOCK // BLOCK_DOCS)))
    sized = _with_sums(_with_sums(weighed, ["g"], total=F.sum("w")), ["g", "comp"], own=F.sum("w"))
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("long")
    large = F.col("own") > BLOCK // 2
    blk = F.when(F.col("total") <= BLOCK, F.lit(0).cast("long")).when(large, F.xxhash64("comp", F.pmod(F.xxhash64("id"), parts("own")))).otherwise(F.pmod(F.xxhash64("comp"), parts("total")))
    dealt = sized.select("g", "id", "n", "most", "comp", blk.alias("blk"))
    edges = [f(c).alias(k) for k, f, c in (("c0", F.min, "comp"), ("c1", F.max, "comp"), ("n0", F.min, "n"), ("m1", F.max, "most"))]
    blocks = cut(dealt.join(sets, "id").groupBy("g", "blk").agg(F.collect_list(F.struct("id", "comp", "full")).alias("m"), *edges))
    x, y = (blocks.select("g", *(F.col(c).alias(f"{s}_{c}") for c in ("blk", "c0", "c1", "n0", "m1"))) for s in "xy")
    settled = "x_c0 = x_c1 and y_c0 = y_c1 and x_c0 = y_c0"
    pairs = join_anew(x, y, "g").filter(f"x_blk <= y_blk and x_n0 <= y_m1 and y_n0 <= x_m1 and not ({settled})").select("g", "x_blk", "y_blk")
    for s in "xy":
        side = blocks.select("g", F.col("blk").alias(f"{s}_blk"), F.col("m").alias(s))
        pairs = pairs.join(side, ["g", f"{s}_blk"])
    return pairs.select("x", "y").mapInArrow(_block_links, "a long, b long")


def _told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with a vertex ``id`` for each distinct set of an id, and the links between those of one id.

    The first set of an id is the id itself; others, where rows repeat an id,
    get numbers above all ids.
    """
    span = rows.groupBy("doc_id").agg(F.min("fp_lo").alias("first"), F.max("fp_lo").alias("last")).withColumn("several", F.col("first") != F.col("last"))
    top, several = span.agg(F.max("doc_id"), F.coalesce(F.max("several"), F.lit(False))).first()
    if not several:
        return rows.withColumn("id", F.col("doc_id")), None
    if top >= 1 << 62:
        raise ValueError("ids that repeat with different texts need room above them: the largest must be under 2**62")
    more = rows.join(span.filter("several").select("doc_id", "first"), "doc_id").filter(F.col("fp_lo") != F.col("first")).select("doc_id", "fp_hi", "fp_lo", "n").distinct()
    more = cut(more).withColumn("extra", F.monotonically_increasing_id() + top + 1)
    more = cut(more)
    named = rows.join(more, ["doc_id", "fp_hi", "fp_lo", "n"], "left").withColumn("id", F.coalesce("extra", "doc_id")).drop("extra")
    return named, more.select(F.col("doc_id").alias("a"), F.col("extra").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: int | None = SKETCH) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Texts are lower-cased (A-Z) and split at ASCII white space.  Null and
    empty texts have no shingles and are linked with nothing.  A null id can't
    name a component: its row is returned with a null ``component_id`` and
    ``kept`` true, and takes no part.  Rows that repeat an id are one vertex,
    linked with what any of their texts is linked with.  Ties go to the smaller
    id.  An empty table gives no rows.  Other columns of ``docs`` are not
    looked at.  ``sketch=None`` retains whole sets, so that no pair is left to
    chance, at the price of a list entry for each shingle.
    """
    docs = id_text(docs, id_col, text_col)
    size = 1 << 40 if sketch is None else sketch
    exact = size * NUM // DEN  # sets up to here have exact lists
    raw = cut(docs.mapInArrow(_sketches(size), "doc_id long, n long, fp_hi long, fp_lo long, sketch binary"))
    named, repeats = _told_apart(raw.filter("doc_id is not null"))
    digest = F.xxhash64("fp_hi", "fp_lo", "n")
    # the added key has both sides shuffled anew, so that a large class can be split; see _with_sums
    classes = named.filter("n > 0").groupBy("fp_hi", "fp_lo", "n").agg(F.min("id").alias("rep")).withColumn("k", digest)
    member = cut(named.select("doc_id", "id", "n", "fp_hi", "fp_lo", digest.alias("k")).join(classes, ["k", "fp_hi", "fp_lo", "n"], "left").select("doc_id", "id", "n", F.coalesce("rep", "id").alias("rep")))
    first = member.filter("n > 0 and id = rep").select("id").distinct()
    reps = named.filter("n > 0").join(first, "id", "left_semi").select("id", "n", "sketch", "doc_id", "fp_lo").dropDuplicates(["id"])
    values = reps.mapInArrow(_values, "v long, id long, n long").repartition("v")
    df = values.groupBy("v").agg(F.count("*").alias("df"))
    shared = values.join(df.filter("df > 1"), "v")
    held = F.least(F.col("n"), F.lit(size))
    need = F.when(F.col("n") <= exact, F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1).otherwise(held - SHARED + 1)
    order = Window.partitionBy("id").orderBy("df", "v")
    per_doc = Window.partitionBy("id")
    ranked = shared.withColumns({"alone": held - F.count("*").over(per_doc), "at": F.row_number().over(order)}).withColumn("at", F.col("alone") + F.col("at"))
    # Two sets of which this is the first common value share n - at + 1 values at most, and 3/7 of n + n' or more at the threshold.
    at_least = F.floor((F.col("n") - F.col("at") + 1) * (NUM + DEN) / NUM + 1e-9) - F.col("n")
    most = F.when(F.col("n") <= exact, F.least(at_least, F.floor(F.col("n") * DEN / NUM))).otherwise(F.floor(F.col("n") * DEN / NUM)).cast("long")
    lists = cut(ranked.filter(F.col("at") <= need).select("v", "id", "n", most.alias("most")))

    candidates = member.join(lists.select("id").distinct(), "id", "left_semi").filter("id = rep").select("doc_id", "id").distinct()
    if repeats is None:
        texts = docs.select(F.col("doc_id").alias("id"), "text").join(candidates, "id", "left_semi")
    else:  # one id, several texts: the digest tells which
        own = reps.select("id", "doc_id", "fp_lo").join(candidates.select("id"), "id", "left_semi")
        again = docs.filter("doc_id is not null").select("doc_id", "text").distinct()
        texts = again.mapInArrow(_with_digest, "doc_id long, text string, fp_lo long").join(own, ["doc_id", "fp_lo"]).select("id", "text")
    sets = cut(texts.mapInArrow(_full_sets, "id long, full binary").dropDuplicates(["id"]) if repeats is not None else texts.mapInArrow(_full_sets, "id long, full binary"))

    def grouped(comps: DataFrame | None) -> DataFrame:
        """The lists with each document's component, without those that lie in one, and without documents no other of the list fits."""
        now = lists.withColumn("comp", F.col("id")) if comps is None else lists.join(comps.select("id", "component"), "id", "left").select("v", "id", "n", "most", F.coalesce("component", "id").alias("comp"))
        mixed = now.groupBy("v").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("most").alias("top"), F.min("n").alias("low")).filter("c0 <> c1").select("v", "top", "low")
        return now.join(mixed, "v").filter("n <= top and low <= most").select("v", "id", "n", "most", "comp")

    links, comps = None, None
    for k in range(PIVOT_ROUNDS):
        now = grouped(comps)
        rank = F.struct(F.col("id")) if k == 0 else F.struct(F.xxhash64("id", F.lit(k)), F.col("id"))
        pivot = now.groupBy("v").agg(F.min_by(F.struct("id", "n", "most", "comp"), rank).alias("p"))
        pairs = now.join(pivot, "v").filter("comp <> p.comp and n <= p.most and p.n <= most").select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()
        found = cut(_confirmed(pairs, sets, size))
        links = found if links is None else links.union(found)
        comps = cut(quick_labels(links))

    # Lists with the same first document are compared as one group, so that a document meets the others of
    # a family of near copies a few times and not once for each value they share.
    unsettled = grouped(comps)
    first = unsettled.groupBy("v").agg(F.min("id").alias("g"))
    groups = cut(join_anew(unsettled, first, "v").groupBy("g", "id", "n", "comp").agg(F.max("most").alias("most")))
    links = links.union(_between_blocks(groups, sets))
    if repeats is not None:
        tops = member.select("id", "rep").distinct()
        ends = repeats.join(tops.select(F.col("id").alias("a"), F.col("rep").alias("rep_a")), "a").join(tops.select(F.col("id").alias("b"), F.col("rep").alias("rep_b")), "b")
        links = links.union(ends.select("rep_a", "rep_b")).union(member.filter("id <> rep").select("id", "rep"))
    comps = connected_components(links)

    component = F.least(F.coalesce("component", "rep"), F.col("rep"))
    result = member.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    nameless = raw.filter("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return result.withColumn("kept", F.col("doc_id") == F.col("component_id")).unionByName(nameless.withColumn("kept", F.lit(True)))


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(sh)) AS h FROM s),
f AS (SELECT h FROM e GROUP BY h HAVING count(*) > 1),
g AS (SELECT e.doc_id, e.h FROM e JOIN f USING (h)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS t FROM n UNION SELECT r.id, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.t),
c AS (SELECT id, min(t) AS component_id FROM r GROUP BY id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON c.id = n.doc_id
"""
