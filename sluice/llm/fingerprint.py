"""Document fingerprints from closed syncmers.

A k-mer (WIDTH code points) is chosen if its least inner substring (INNER code points, ordered by hash) lies at its
start or its end. The choice depends on the k-mer alone, not on its surroundings, so equal passages have equal anchors
wherever they stand, and the anchors of a text put together from parts are those of the parts and of the seams. Any
SHORT consecutive code points hold an anchor. An anchor is a position and the 32-bit hash of its k-mer, packed into one number (pos_of, hash_of). A fingerprint lists the hashes of a text's anchors in their
order, repeats included; a text too short to be sure of one (SHORT) lists its inner substrings instead, or itself. The
likeness of two fingerprints is the share of their hashes that can be paired with equal ones (Dice of bags).

Everything is built-in functions on arrays. Texts are cut into overlapping pieces first, because substrings of a long
string cost its length, and so that only the anchors of a long text are held, not all of its inner substrings.

Defined results: a null text counts as empty, and an empty text has an empty fingerprint; two empty fingerprints are
alike (1), an empty and another one not (0). Null ids come after all others; of rows with equal ids the one with the
smaller text comes first, so repeated rows follow each other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of an inner substring, inner substrings of a k-mer, and code points of a k-mer.
INNER, SPAN = 5, 16
WIDTH = INNER + SPAN - 1
#: Code points that are sure to hold an anchor: among SPAN - 1 k-mers in a row the least inner substring is at an edge of one.
SHORT = WIDTH + SPAN - 2
#: k-mers of a piece, and of the larger pieces that long texts are cut into before.
PIECE, LARGE = 1024, 1 << 16


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body for a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def pieces(text: Column, step: int) -> Column:
    """Substrings of a text that hold each of its k-mers once, at most step k-mers each; none if it has no k-mer."""
    last = F.char_length(text) - WIDTH
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(step + WIDTH - 1)))


def least_of(value: Column, values: Column, at: list[Column]) -> Column:
    """Whether a value is not above those at some places, null if one lies outside; most are settled by the first comparisons."""
    first, *rest = at
    holds = value <= F.get(values, first)
    return holds & least_of(value, values, rest) if rest else holds


def inner(text: Column) -> Column:
    """Hashes of all inner substrings of a text of at least INNER code points."""
    from_each = lambda c: F.transform(c, lambda x, i: F.xxhash64(x, *[F.get(c, i + j) for j in range(1, INNER)]))
    return bound(F.split(text, ""), lambda c: F.slice(from_each(c), F.lit(1), F.size(c) - (INNER - 1)))


def chosen(piece: Column) -> Column:
    """Anchors of one piece of at least WIDTH code points. A k-mer is hashed by inner substrings that cover it."""
    edges = lambda h: F.slice(F.transform(h, lambda x, i: F.least(x, F.get(h, i + (SPAN - 1)))), F.lit(1), F.size(h) - (SPAN - 1))
    hashed = lambda h, i: F.hash(*[F.get(h, i + j) for j in range(0, SPAN, INNER)])
    taken = lambda h: F.transform(edges(h), lambda e, i: F.when(least_of(e, h, [i + j for j in range(1, SPAN - 1)]), packed(i, hashed(h, i))))
    return bound(inner(piece), lambda h: F.array_compact(taken(h)))


def packed(pos: Column, hashed: Column) -> Column:
    """An anchor as one number: the position above the hash's 32 bits."""
    return F.shiftleft(pos.cast("long"), 32).bitwiseOR(hashed.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def pos_of(anchor: Column) -> Column:
    return F.shiftright(anchor, 32).cast("int")


def hash_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit(0xFFFFFFFF))


def moved(found: Column, by: Column) -> Column:
    """Anchors with their positions moved up."""
    return F.transform(found, lambda a: a + F.shiftleft(by.cast("long"), 32))


def anchors(text: Column) -> Column:
    """Anchors of the k-mers of a whole text, in order; none if no k-mer is chosen. Positions count from 0."""
    small = lambda large: F.flatten(F.transform(pieces(large, PIECE), lambda p, i: moved(chosen(p), i * PIECE)))
    long = F.flatten(F.transform(pieces(text, LARGE), lambda p, i: moved(small(p), i * LARGE)))
    return F.when(F.char_length(text) <= LARGE, small(text)).otherwise(long)


def hashes(found: Column, text: Column) -> Column:
    """The hashes of a text's anchors in their order; of a short text those of its inner substrings, or its own."""
    n, none = F.char_length(text), F.array().cast("array<bigint>")
    short = F.when(n >= INNER, F.transform(inner(text), lambda h: hash_of(F.hash(h).cast("long")))).when(n > 0, F.array(hash_of(F.hash(text).cast("long")))).otherwise(none)
    return F.when(n >= SHORT, F.transform(found, hash_of)).otherwise(short)


def written(values: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(values, lambda h: F.lpad(F.hex(h), 8, "0")), ""))


def common(a: Column, b: Column) -> Column:
    """Number of the hashes of two fingerprints that can be paired with an equal one of the other."""
    sides = F.sort_array(F.concat(F.transform(a, lambda h: h * 2), F.transform(b, lambda h: h * 2 + 1)))
    # Running over the sorted hashes: the last one, its occurrences in a that are still unpaired, pairs so far.
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("open"), F.lit(0).alias("pairs"))
    same = lambda s, v: F.coalesce(s["last"] == F.shiftright(v, 1), F.lit(False))
    left = lambda s, v: F.when(same(s, v), s["open"]).otherwise(0)
    paired = lambda s, v: (v % 2 != 0) & (left(s, v) > 0)
    opened = lambda s, v: F.when(v % 2 == 0, left(s, v) + 1).when(paired(s, v), left(s, v) - 1).otherwise(left(s, v))
    step = lambda s, v: F.struct(F.shiftright(v, 1).alias("last"), opened(s, v).alias("open"), F.when(paired(s, v), s["pairs"] + 1).otherwise(s["pairs"]).alias("pairs"))
    once = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(once, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(sides, start, step, lambda s: s["pairs"]))


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of two fingerprints that have a partner in the other, 0 to 1."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(2.0 * common(a, b) / n)


def spliced(head: Column, tail: Column, found: Column, next_found: Column, n_head: Column, n_tail: Column) -> Column:
    """Anchors of head + tail, from those of two texts that begin with them; only the seam is looked at again."""
    seam = F.concat(F.right(head, F.lit(WIDTH - 1)), F.left(tail, F.lit(WIDTH - 1)))
    kept = F.filter(found, lambda a: pos_of(a) + WIDTH <= n_head)
    at = F.greatest(F.lit(0), n_head - (WIDTH - 1))
    crossing = F.when(F.char_length(seam) >= WIDTH, moved(chosen(seam), at)).otherwise(F.array().cast("array<bigint>"))
    return F.concat(kept, crossing, moved(F.filter(next_found, lambda a: pos_of(a) + WIDTH <= n_tail), n_head))


def ranges(ids: DataFrame, many: int) -> list[int]:
    """At most many upper bounds, each an id that occurs, that cut the ids into ranges of about equally many rows; the last is the largest id."""
    shares = [k / many for k in range(1, many)] or [0.5]
    found = ids.agg(F.percentile_approx("id", shares, 10_000).alias("inner"), F.max("id").alias("last")).first()
    return sorted({*found["inner"], found["last"]}) if found["last"] is not None else []


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds lie below a value, by binary search; 0 for null."""
    known = F.lit(bounds).cast("array<long>")
    half = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
    below = lambda s: F.coalesce(F.get(known, half(s)) < value, F.lit(False)) & (s["low"] < s["high"])
    step = lambda s: F.struct(F.when(below(s), half(s) + 1).otherwise(s["low"]).alias("low"), F.when(below(s), s["high"]).otherwise(half(s)).alias("high"))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    rounds = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    return F.aggregate(rounds, start, lambda s, _: step(s), lambda s: s["low"])


def followed(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and anchors of each row, and the text and anchors of the row that follows by descending id; the first follows the last.

    One shuffle by ranges of ids: each range's largest id also goes to the range above it, whose last row it follows,
    and the largest of all to the lowest range. Without any id no row is followed.
    """
    rows = docs.select(F.col(doc_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = ranges(rows.select("id"), many)
    own = range_of(F.col("id"), bounds)
    top = F.col("id") == F.lit(bounds[-1] if bounds else None).cast("long")
    to = F.struct(own.alias("range"), F.lit(0).alias("guest"))
    upper = F.struct(F.when(top, 0).otherwise(own + 1).alias("range"), F.when(top, 2).otherwise(1).alias("guest"))
    edge = F.coalesce(F.get(F.lit(bounds).cast("array<long>"), own) == F.col("id"), F.lit(False))
    dealt = rows.select("id", "body", F.explode(F.when(edge, F.array(to, upper)).otherwise(F.array(to))).alias("to"))
    # Sorted before the anchors are there, so that only texts are sorted; the window takes that order.
    order = [F.col("last").asc(), F.col("id").desc_nulls_last(), F.col("body").asc()]
    dealt = dealt.select("id", "body", "to.range", "to.guest", (F.col("to.guest") == 2).alias("last"))
    dealt = dealt.repartition(many, "range").sortWithinPartitions("range", *order).withColumn("found", anchors(F.col("body")))
    order = Window.partitionBy("range").orderBy(*order)
    follow = F.lead(F.struct("body", "found")).over(order)
    return dealt.withColumn("next", follow).where(F.col("guest") == 0).select("id", "body", "found", F.coalesce("next.body", F.lit("")).alias("next_body"), F.coalesce("next.found", F.array().cast("array<bigint>")).alias("next_found"))


def report(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each document and of its text with the last third replaced from the document that follows, and how alike they are."""
    rows = followed(docs, doc_col, text_col).withColumn("n", F.char_length("body"))
    third = F.floor(F.col("n") / 3).cast("int")
    rows = rows.withColumn("n_head", F.col("n") - third).withColumn("n_tail", F.least(third, F.char_length("next_body")))
    rows = rows.withColumn("head", F.left("body", "n_head")).withColumn("tail", F.left("next_body", "n_tail"))
    edited = F.concat("head", "tail")
    parts = [F.col(c) for c in ("head", "tail", "found", "next_found", "n_head", "n_tail")]
    rows = rows.select(F.col("id"), F.col("n"), edited.alias("edited"), hashes(F.col("found"), F.col("body")).alias("own"), hashes(F.col("next_found"), F.col("next_body")).alias("following"), spliced(*parts).alias("spliced"))
    rows = rows.withColumn("other", hashes(F.col("spliced"), F.col("edited")))
    return rows.select(
        *(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_chars")),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        written(F.col("own")).alias("fingerprint"),
        written(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
