"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

All of it is DataFrame functions; nothing runs in Python on the executors.

Base.  E-mail, IP, card and phone are Java regular expressions that match
leftmost without overlap; possessive quantifiers keep them linear and off the
stack.  Positions come from splitting at the matches: the pieces and the
matches alternate, so running lengths in code points give each start.  Running
sums are made in stretches of about a root of their number, so that many
matches in one text cost little more than a few.

Bootstrap.  Base spans are marked in the text, which is then split into tokens;
a token with a mark is a seed.  A token stands in up to two lexical patterns:
its own prefix up to a separator (``password=``) and the word before it; a seed
in the first of them that it has.
Patterns that ``SEEDS`` different seeds have, and at least a share ``HOPE`` of
all that follows them, are the contexts; every other token in a context is a
candidate, with or without digits.  Patterns and tokens
(instances) form a bipartite graph, aggregated over the corpus; a few rounds
move confidence along it: a pattern is as good as the mean of its instances,
damped by ``DAMP`` unseen doubtful ones, and an instance is certain if it is a
seed and else the noisy-or of its good patterns.  Patterns with ``ACCEPT``
confidence (``STRICT`` for candidates without a digit) and ``SUPPORT``
instances mark their candidates as personal data of kind ``id``.  Words after
an identifier are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.cluster import cut, documents, id_text

KINDS = ("email", "ip", "card", "phone")
#: In kind order.  \G is the end of the last match: a start inside a run that can't match from its beginning can't match either.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every match contains.
PRESENT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SPACE = r"[\x20\x09-\x0D]"
#: The mark before a base span and the stand-in for white space inside one; texts that have them get ``INSTEAD``.
MARK, GAP, INSTEAD = "\x01", "\x02", "\x03"
#: Letters and a separator that begin a token, and what it needs to go on.
PREFIX = r"^(\p{L}{3,}+[=:#_-])"
ROUNDS = 3
DAMP = 2.0
ACCEPT, STRICT, SUPPORT, SEEDS = 0.6, 0.8, 5, 3
MIN_LENGTH = 3
#: Contexts of which fewer instances than this share are seeds (by a sketch) are left at once.
HOPE = 0.1
#: Contexts are broadcast up to here, and joined by a shuffle beyond.
BROADCAST_ROWS = 100_000

SPAN = "array<struct<start: int, kind: int, stop: int>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(lengths: Column) -> Column:
    """What stands before each element of an array of ints, summed up."""

    def stretch(part: Column, before: Column) -> Column:
        start = F.struct(before.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def stretches(values: Column) -> Column:
        return _let(
            F.ceil(F.sqrt(F.size(values))).cast("int"),
            lambda k: _let(
                F.transform(F.sequence(F.lit(0), F.size(values) - 1, k), lambda at: F.slice(values, at + 1, k)),
                lambda parts: _let(
                    stretch(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + x)), F.lit(0)),
                    lambda before: F.flatten(F.zip_with(parts, before, stretch)),
                ),
            ),
        )

    return _let(lengths, lambda values: F.when(F.size(values) > 0, stretches(values)).otherwise(F.array().cast("array<int>")))


def _pieces(text: Column, pattern: str) -> Column:
    """Array of (before, match): each match and what stands between it and the last one."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    return _let(found, lambda m: F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(m)), m, lambda p, x: F.struct(p.alias("before"), x.alias("match"))))


def _positions(text: Column, pattern: str) -> Column:
    """Array of (start, match) of all matches, in code points."""
    return _let(
        _pieces(text, pattern),
        lambda found: F.zip_with(found, _running(F.transform(found, lambda x: F.length(x["before"]) + F.length(x["match"]))), lambda x, at: F.struct((at + F.length(x["before"])).alias("start"), x["match"].alias("match"))),
    )


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(k % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "email":
        return F.lit(True)
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    """Spans of the base patterns, by start, then kind."""
    nothing = F.array().cast(SPAN)

    def spans(k: int, kind: str) -> Column:
        found = F.filter(_positions(text, PATTERNS[kind]), lambda m: _valid(kind, m["match"]))
        own = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), (m["start"] + F.length(m["match"])).alias("stop")))
        return F.when(text.rlike(PRESENT[kind]), own).otherwise(nothing)

    return F.array_sort(F.concat(*(spans(k, kind) for k, kind in enumerate(KINDS))))


def _marked(text: Column, inside: str) -> Column:
    """The text with a mark before each valid base match, and ``inside`` for each white space in one ($0 is the space)."""

    def mark(text: Column, kind: str) -> Column:
        def one(x: Column) -> Column:
            return F.concat(x["before"], F.when(_valid(kind, x["match"]), F.concat(F.lit(MARK), F.regexp_replace(x["match"], SPACE, inside))).otherwise(x["match"]))

        def whole(t: Column) -> Column:
            return F.concat(F.array_join(F.transform(_pieces(t, PATTERNS[kind]), one), ""), F.element_at(F.split(t, PATTERNS[kind], -1), -1))

        return F.when(text.rlike(PRESENT[kind]), _let(text, whole)).otherwise(text)

    out = F.translate(text, MARK + GAP, INSTEAD * 2)
    for kind in KINDS:
        out = _let(out, _of(mark, kind))
    return out


def _of(function, kind: str):
    return lambda text: function(text, kind)


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+", -1), "")


def _placed_tokens(text: Column) -> Column:
    """Array of (start, token) of a marked text; starts don't count the marks."""

    def placed(pieces: Column) -> Column:
        starts = _running(F.transform(pieces, lambda t: F.length(F.replace(t, F.lit(MARK), F.lit(""))) + 1))
        return F.filter(F.zip_with(pieces, starts, lambda t, at: F.struct(at.alias("start"), t.alias("token"))), lambda x: x["token"] != "")

    return _let(F.split(text, SPACE, -1), placed)


def _core(token: Column) -> tuple[Column, Column]:
    """The token without punctuation at its ends, and how much was cut in front."""
    rest = F.regexp_replace(token, r"^[^\p{L}\p{N}+]++", "")
    return F.regexp_replace(rest, r"(?<=[\p{L}\p{N}+])[^\p{L}\p{N}+]++$", ""), F.length(token) - F.length(rest)


def _before(last: Column) -> Column:
    return F.concat(F.lit("before:"), F.lower(last))


def seeds_of(text: Column) -> Column:
    """Array of (pattern, instance, token) of a text's base spans; ``token``: the first token of an instance, without punctuation."""

    def seed(tokens: Column):
        def one(token: Column, k: Column) -> Column:
            left, span = F.substring_index(token, MARK, 1), F.lower(F.substring_index(token, MARK, -1))
            prefix = F.regexp_extract(left, r"(?<!\p{L})(\p{L}{3,}+[=:#_-])$", 1)
            last = F.when(k > 0, F.get(tokens, k - 1))
            pattern = F.when(F.length(prefix) > 0, F.concat(F.lit("prefix:"), F.lower(prefix))).when(~last.rlike(f"[0-9{MARK}]"), _before(last))
            whole = F.when(F.length(prefix) > 0, span).otherwise(F.lower(F.concat(left, span)))
            return F.when(F.contains(token, F.lit(MARK)), F.struct(pattern.alias("pattern"), F.translate(span, GAP, " ").alias("instance"), _core(F.substring_index(whole, GAP, 1))[0].alias("token")))

        return one

    return _let(_tokens(_marked(text, GAP)), lambda t: F.filter(F.transform(t, seed(t)), lambda x: x["pattern"].isNotNull()))


def in_contexts(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(doc_id, fp, k, token, pattern)`` of the tokens of ``docs(doc_id, text, fp)`` that stand in ``contexts(pattern)``; ``k`` counts from 0."""
    tokens = docs.select("doc_id", "fp", _tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    pairs = F.arrays_zip(F.col("t").alias("token"), F.concat(F.array(F.lit(None).cast("string")), F.slice("t", 1, F.size("t") - 1)).alias("last"))
    each = tokens.select("doc_id", "fp", F.posexplode(pairs).alias("k", "x")).select("doc_id", "fp", "k", "x.*").toDF("doc_id", "fp", "k", "token", "last")
    prefix = F.when(F.col("token").rlike(PREFIX + "."), F.concat(F.lit("prefix:"), F.lower(F.regexp_extract("token", PREFIX, 1))))
    held = each.select("doc_id", "fp", "k", "token", F.explode(F.array_compact(F.array(_before(F.col("last")), prefix))).alias("pattern"))
    few = contexts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return held.join(F.broadcast(contexts) if few else contexts, "pattern")


def _skip(pattern: Column) -> Column:
    """How much of the token is the pattern itself."""
    return F.when(pattern.startswith("prefix:"), F.length(pattern) - len("prefix:")).otherwise(F.lit(0))


def score_patterns(occurrences: DataFrame) -> DataFrame:
    """``(pattern, score, support, seeds)`` from ``(pattern, instance, seed)`` rows, after ``ROUNDS`` rounds."""
    edges = cut(occurrences.groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("double")).alias("seed")))
    seeds = edges.groupBy("instance").agg(F.max("seed").alias("seed"))
    belief = seeds.select("instance", F.col("seed").alias("belief"))
    scores = None
    for k in range(ROUNDS):
        scores = cut(edges.join(belief, "instance").groupBy("pattern").agg((F.sum("belief") / (F.count("*") + DAMP)).alias("score"), F.count("*").alias("support"), F.sum("seed").alias("seeds")))
        if k + 1 < ROUNDS:
            doubt = edges.join(scores.filter(f"score >= {ACCEPT / 2}").select("pattern", "score"), "pattern").groupBy("instance").agg(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))).alias("doubt"))
            belief = seeds.join(doubt, "instance", "left").select("instance", F.when(F.col("seed") > 0, F.lit(1.0)).otherwise(F.coalesce(1 - F.exp("doubt"), F.lit(0.0))).alias("belief"))
    return scores


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, base, spans``, arrays of (start, kind, stop).

    Offsets are code points, ends exclusive; ``kind`` indexes :data:`KINDS`,
    and 4 is an identifier found by context.  ``spans`` holds the base ones
    too.  Null and empty texts have none.  Null ids and repeated rows are
    treated like others; an empty table gives no rows.  Other columns are not
    looked at.
    """
    docs = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("fp", F.xxhash64("text"))
    rows = docs.withColumn("base", base_spans(F.col("text")))
    none = F.array().cast("array<struct<pattern: string, instance: string, token: string>>")
    rows = cut(rows.select("doc_id", "fp", "base", F.when(F.size("base") > 0, seeds_of(F.col("text"))).otherwise(none).alias("seeds")))
    seeds = cut(rows.select(F.explode("seeds").alias("s")).select("s.*").distinct())
    known = cut(seeds.groupBy("pattern").agg(F.count_distinct("instance").alias("seeds")).filter(f"seeds >= {SEEDS}"))
    sizes = in_contexts(docs, known.select("pattern")).groupBy("pattern").agg(F.approx_count_distinct(F.lower("token")).alias("size"))
    contexts = cut(known.join(sizes, "pattern").filter(F.col("seeds") >= HOPE * F.col("size")).select("pattern"))
    found = in_contexts(docs, contexts).withColumn("instance", F.lower(_core(F.expr("substring(token, 1 + if(startswith(pattern, 'prefix:'), length(pattern) - 7, 0))"))[0]))
    found = found.filter(F.length("instance") >= MIN_LENGTH).select("doc_id", "fp", "k", "pattern", "instance")
    found = cut(found.join(seeds.select("pattern", F.col("token").alias("instance")).distinct(), ["pattern", "instance"], "left_anti"))
    edges = seeds.join(contexts, "pattern").select("pattern", "instance", F.lit(True).alias("seed")).unionByName(found.select("pattern", "instance", F.lit(False).alias("seed")))
    good = score_patterns(edges).filter(f"score >= {ACCEPT} and support >= {SUPPORT} and seeds >= {SEEDS}").select("pattern", "score")
    new = found.join(good, "pattern").filter((F.col("score") >= STRICT) | F.col("instance").rlike("[0-9]"))
    new = new.groupBy("doc_id", "fp", "k").agg(F.max(_skip(F.col("pattern"))).alias("skip"))  # without a prefix that is a pattern itself
    new = cut(new.groupBy(F.col("doc_id").alias("new_id"), F.col("fp").alias("new_fp")).agg(F.collect_list(F.struct("k", "skip")).alias("at")))
    few = new.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10
    same = F.expr("doc_id <=> new_id and fp = new_fp")
    texts = docs.dropDuplicates(["doc_id", "fp"]) if not few else docs
    placed = texts.join(F.broadcast(new) if few else new, same).select("new_id", "new_fp", _places(F.col("text"), F.col("at")).alias("more")).dropDuplicates(["new_id", "new_fp"])
    joined = rows.join(placed, same, "left")
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce(F.col("more").cast(SPAN), F.array().cast(SPAN)))).alias("spans"))


def _places(text: Column, at: Column) -> Column:
    """The spans of the tokens numbered ``at(k, skip)``, without those that a base span touches."""

    def one(tokens: Column):
        def place(x: Column) -> Column:
            return _let(F.get(tokens, x["k"]), lambda t: _let(F.substring(t["token"], x["skip"] + 1, F.length(t["token"])), lambda rest: span(t, x["skip"], rest)))

        def span(t: Column, skip: Column, rest: Column) -> Column:
            core, lead = _core(rest)
            start = t["start"] + skip + lead
            return F.when(~F.contains(t["token"], F.lit(MARK)), F.struct(start.alias("start"), F.lit(len(KINDS)).alias("kind"), (start + F.length(core)).alias("stop")))

        return place

    return _let(_placed_tokens(_marked(text, "$0" + MARK)), lambda t: F.array_compact(F.transform(at, one(t))))


def _written(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, "id")))
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _equals(k: int):
    return lambda kind: kind == k


def op3_contextual_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    counts = [F.size(F.filter(F.transform("base", lambda s: s["kind"]), _equals(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))
