"""Repair of the turn structure of conversations, by depth-first branch-and-bound.

Each row has a first fault: blank, duplicate (role and text seen earlier in the conversation) or truncated (its last visible
character ends no sentence). Edits are Keep (0), Rerole to user or assistant (2), Delete (3, required for blank and
duplicate rows) and Insert of an empty user or assistant turn (2); truncated rows that stay add 1. Repaired role
initials are `(s?(ua)+)?`. Of the cheapest repairs that with the least audit, the initials of its edits, is taken.

A search node is a number of rows done and the last role given. Nodes lie on an explicit stack. One is cut off if its
cost and the suffix's lower bound exceed the incumbent's cost, if they equal it and the audit cannot become smaller,
or if the dominance table of its place holds a prefix no worse. The stack running empty proves the incumbent. Bounds are
those of the best completion by cost, so whole conversations take time in proportion to their rows. Equal costs at one
node never have audits of which one begins the other (it would have more inserts), so prefixes can be compared.

A conversation of at most SEGMENT rows and SEGMENT_BYTES is one group of a task. Longer ones, counted first, are never
gathered: their rows are sorted over all tasks and cut into segments, each searched for the best way from every role to
every role; a conversation's ways are put together in order, and the edits are carried out by segment. What goes through
one task is a row for each segment, and their texts one after another for the digest, which is sequential.

Defined results: null roles and texts are one space; null turns come first, and rows of equal turns go by role, then text;
a role without characters has no initial and cannot be kept; null conv_ids are one conversation; a conversation without
rows has an empty audit and the empty string's digest; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import materialize, schema_with, small_batches

#: Rows and bytes of text that one search holds.
SEGMENT, SEGMENT_BYTES = 4096, 8 << 20
#: White space, ends of sentences, and adjacent role initials that are legal.
SPACE, ENDS, LEGAL = " \t\n\x0b\x0c\r", ".!?", ("su", "ua", "au")
#: Costs of the edits, and of keeping a truncated row.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Last role given: none, system, user, assistant. Where a conversation may end, and the next role that may be given or inserted.
NONE, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (NONE, ASSISTANT)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
FAR = 1 << 40
OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that a checksum of conversation and turn picks: every twentieth each dropped, emptied, unpunctuated, repeated, given to the user."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    pick = F.crc32(F.encode(F.concat_ws(":", shown("conv_id"), shown("turn")), "UTF-8")) % 20
    role, text = shown("role"), shown("text")
    text = F.when(pick == 1, "").when(pick == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(pick == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    made = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(pick == 4, "user").otherwise(role).alias("role"), text.alias("text"), (pick == 0).alias("gone"), F.explode(copies).alias("copy"))
    return made.drop("copy")


def fault(role: str, text: str, repeated: bool) -> str:
    """b, d, t or - for the first fault of a row."""
    shown = text.rstrip(SPACE)
    if not shown:
        return "b"
    return "d" if repeated else "-" if shown[-1] in ENDS else "t"


def inserted(end: int) -> list[int]:
    """Cost of inserts alone from each last role to a last role."""
    out = [FAR] * 4
    for q in range(4):
        at, cost = q, 0
        while at != end and cost <= 3 * INSERT:
            at, cost = NEXT[at], cost + INSERT
        out[q] = cost if at == end else FAR
    return out


def moves(q: int, kind: tuple[str, str]) -> Iterator[tuple[str, int, int]]:
    """Edits of one row after a last role, in the order of their letters: letter, cost, new last role."""
    initial, wrong = kind
    yield "D", DELETE, q
    if wrong not in "bd":
        more = TRUNCATED if wrong == "t" else 0
        if (q, initial) in KEPT:
            yield "K", more, KEPT[q, initial]
        yield "R", REROLE + more, NEXT[q]


def suffix_bounds(kinds: list[tuple[str, str]], ends: tuple[int, ...]) -> list[list[int]]:
    """Least cost from each number of rows done and last role to one of the ends."""
    at = [min(c) for c in zip(*map(inserted, ends), strict=True)]
    out = [at]
    for kind in reversed(kinds):
        row = [min(cost + out[-1][to] for _, cost, to in moves(q, kind)) for q in range(4)]
        for _ in range(3):
            row = [min(row[q], INSERT + row[NEXT[q]]) for q in range(4)]
        out.append(row)
    return out[::-1]


def search(kinds: list[tuple[str, str]], start: int = NONE, ends: tuple[int, ...] = FINAL, bounds: list[list[int]] | None = None) -> tuple[int, str] | None:
    """Cost and audit of the best repair of rows (initial, fault) from a last role to one of the ends; None if there is none."""
    bounds = suffix_bounds(kinds, ends) if bounds is None else bounds
    n, cost, audit = len(kinds), FAR, ""
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        done, q, g, path = stack.pop()
        f = g + bounds[done][q]
        if f >= FAR or f > cost or (f == cost and path > audit[: len(path)]):
            continue
        if (done, q) in table and table[done, q] <= (g, path):
            continue
        table[done, q] = (g, path)
        if done == n and q in ends and (g, path) < (cost, audit or "~"):
            cost, audit = g, path
        following = [(done, NEXT[q], g + INSERT, path + "I")]
        if done < n:
            given = [(done + 1, to, g + c, path + letter) for letter, c, to in moves(q, kinds[done])]
            following = given[:1] + following + given[1:]
        # The most promising is looked at first: by bound, then by letter.
        following.sort(key=lambda x: (x[2] + bounds[x[0]][x[1]], x[3]), reverse=True)
        stack += following
    return (cost, audit) if cost < FAR else None


def edited(audit: str, rows: list[tuple[str, str]], start: int = NONE) -> list[tuple[str, str]]:
    """The turns (role, text) that an audit makes of rows."""
    out, q, left = [], start, iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        q = KEPT[q, role[:1]] if letter == "K" else NEXT[q]
        out.append((role if letter == "K" else ROLE[q], text))
    return out


def as_text(turns: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in turns).encode()


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in pairwise(initials))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Rows (without their key) of each conversation of sorted batches that begin with conv_id."""
    key, rows = None, []
    for batch in batches:
        for name, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and name != key:
                yield key, rows
                rows = []
            key = name
            rows.append(tuple(row))
    if rows:
        yield key, rows


def emitted(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def in_batches(made: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 500, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded numbers and bytes of text."""
    rows, size = [], 0
    for row in made:
        rows.append(row)
        size += sum(len(x) for x in row if isinstance(x, str | bytes))
        if len(rows) >= most or size > most_bytes:
            yield emitted(names, kinds, rows)
            rows, size = [], 0
    if rows:
        yield emitted(names, kinds, rows)


ORDER = ("conv_id", "turn", "role", "text")


def short_repairs(rows: DataFrame) -> DataFrame:
    """Conversations that one task holds, one after another."""
    key = pa.int64() if rows.schema["conv_id"].dataType.simpleString() == "bigint" else pa.string()
    kinds = [key, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv_id", *(x.split()[0] for x in OUT.split(", "))]

    def one(name: object, rows: list[tuple]) -> tuple:
        rows = [r for r in rows if not r[3]]
        turns, seen, kinds = [t for t, *_ in rows if t is not None], set(), []
        for _, role, text, _ in rows:
            kinds.append((role[:1], fault(role, text, (role, text) in seen)))
            seen.add((role, text))
        cost, audit = search(kinds)
        wrong = [w for _, w in kinds]
        gaps = max(turns) - min(turns) + 1 - len({*turns}) if turns else 0
        text = as_text(edited(audit, [(role, text) for _, role, text, _ in rows]))
        return name, gaps, *(wrong.count(w) for w in "bdt"), illegal([i for i, _ in kinds]), cost, audit, hashlib.sha256(text).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches((one(*g) for g in grouped(batches)), names, kinds)

    dealt = rows.select(*ORDER, "gone").repartition("conv_id").sortWithinPartitions(*ORDER)
    return dealt.mapInArrow(run, schema_with(rows, ["conv_id"], OUT))


def marked(rows: DataFrame) -> DataFrame:
    """Different rows (conv_id, turn, role, text) of long conversations with n, how many rows are like this, and again, whether role and text occur at an earlier turn.

    Equal rows are added up before they are shuffled; role and text are known by 128 bits.
    """
    same = rows.groupBy(*ORDER).agg(F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    same = materialize(same.withColumns({"d1": F.xxhash64("role", "text"), "d2": F.xxhash64("text", F.lit(1), "role"), "place": place}))
    first = same.groupBy(F.col("conv_id").alias("c"), F.col("d1").alias("e1"), F.col("d2").alias("e2")).agg(F.min("place").alias("first"), F.count("*").alias("places")).where("places > 1")
    found = same.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    return found.select(*ORDER, "place", "n", F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("again"))


WAYS = "ways array<struct<start:int,end:int,cost:long,audit:string>>"
WAYS_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def segments(rows: DataFrame) -> DataFrame:
    """Marked rows in the order of their conversations, cut into segments: their rows, faults, and best ways between last roles."""
    key = pa.int64() if rows.schema["conv_id"].dataType.simpleString() == "bigint" else pa.string()
    names = ["conv_id", "part", "seq", "roles", "texts", "wrong", "ways"]
    kinds = [key, pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), WAYS_TYPE]
    most, most_bytes = SEGMENT, SEGMENT_BYTES

    def finished(name: object, part: int, seq: int, rows: list[tuple[str, str, str]]) -> tuple:
        what = [(role[:1], wrong) for role, _, wrong in rows]
        bounds = {end: suffix_bounds(what, (end,)) for end in range(4)}
        found = ((a, b, search(what, a, (b,), bounds[b])) for a in range(4) for b in range(4))
        ways = [{"start": a, "end": b, "cost": way[0], "audit": way[1]} for a, b, way in found if way]
        return name, part, seq, [r for r, _, _ in rows], [t for _, t, _ in rows], "".join(w for *_, w in rows), ways

    def cut(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[tuple]:
        key, seq, rows, size = None, 0, [], 0
        for batch in batches:
            for name, role, text, n, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for copy in range(n):
                    if rows and (name != key or len(rows) >= most or size >= most_bytes):
                        yield finished(key, part, seq, rows)
                        seq, rows, size = seq + 1, [], 0
                    key = name
                    rows.append((role, text, fault(role, text, again or copy > 0)))
                    size += len(text)
        if rows:
            yield finished(key, part, seq, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(cut(batches, TaskContext.get().partitionId()), names, kinds, most=1)

    dealt = rows.repartitionByRange("conv_id", "place", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv_id", "place", "role", "text")
    return dealt.select("conv_id", "role", "text", "n", "again").mapInArrow(run, schema_with(rows, ["conv_id"], f"part int, seq int, roles array<string>, texts array<string>, wrong string, {WAYS}"))


def joined(parts: list[list[dict]]) -> tuple[int, str, list[tuple[int, int]]]:
    """Cost and audit of the best repair over segments in order, and the last roles before and after each."""
    best: dict[int, tuple[int, str]] = {NONE: (0, "")}
    back: list[dict[int, int]] = []
    for ways in parts:
        new: dict[int, tuple[int, str]] = {}
        frm: dict[int, int] = {}
        for way in ways:
            if way["start"] in best:
                cost, audit = best[way["start"]]
                found = (cost + way["cost"], audit + way["audit"])
                if way["end"] not in new or found < new[way["end"]]:
                    new[way["end"]], frm[way["end"]] = found, way["start"]
        best = new
        back.append(frm)
    end = min((q for q in best if q in FINAL), key=best.__getitem__)
    cost, audit = best[end]
    path = []
    for frm in reversed(back):
        path.append((frm[end], end))
        end = frm[end]
    return cost, audit, path[::-1]


def long_repairs(rows: DataFrame) -> DataFrame:
    """Conversations of any length, by segments."""
    key = pa.int64() if rows.schema["conv_id"].dataType.simpleString() == "bigint" else pa.string()
    same_key = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    found = materialize(marked(rows))
    cut = materialize(segments(found))
    steps_type = pa.list_(pa.struct([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int32()), ("audit", pa.string())]))
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "steps"]
    kinds = [key, *[pa.int64()] * 5, pa.string(), steps_type]

    def fold(name: object, parts: list[tuple]) -> tuple:
        cost, audit, path = joined([ways for *_, ways in parts])
        inside = sum(x[4] for x in parts) + sum(a[3] + b[2] not in LEGAL for a, b in pairwise(parts))
        of = [{(w["start"], w["end"]): w["audit"] for w in ways} for *_, ways in parts]
        steps = [{"part": p[0], "seq": p[1], "start": a, "audit": of[k][a, b]} for k, (p, (a, b)) in enumerate(zip(parts, path, strict=True))]
        return name, *(sum(x[5].count(w) for x in parts) for w in "bdt"), inside, cost, audit, steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches((fold(*g) for g in grouped(batches)), names, kinds, most=1)

    initials = F.transform("roles", lambda r: F.left(r, F.lit(1)))
    bad = F.size(F.filter(F.zip_with(F.slice("initials", F.lit(1), F.size("initials") - 1), F.slice("initials", F.lit(2), F.size("initials") - 1), lambda a, b: F.concat(a, b)), lambda x: ~x.isin(*LEGAL)))
    narrow = cut.withColumn("initials", initials).select("conv_id", "part", "seq", F.element_at("initials", 1).alias("first"), F.element_at("initials", -1).alias("last"), bad.cast("long").alias("bad"), "wrong", "ways")
    ways = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    whole = materialize(ways.mapInArrow(run, schema_with(rows, ["conv_id"], "blank long, duplicate long, truncated long, illegal long, cost long, audit string, steps array<struct<part:int,seq:int,start:int,audit:string>>")))

    def carried_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(name, part, seq, as_text(turns)) for name, part, seq, roles, texts, start, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (turns := edited(audit, list(zip(roles, texts, strict=True)), start))]
            yield from in_batches(iter(made), ["conv_id", "part", "seq", "body"], [key, pa.int32(), pa.int32(), pa.binary()])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, hashed = None, None
        for batch in batches:
            for c, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if hashed is not None and c != name:
                    yield emitted(["conv_id", "repaired_sha256"], [key, pa.string()], [(name, hashed.hexdigest())])
                    hashed = None
                if hashed is None:
                    name, hashed = c, hashlib.sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(body)
        if hashed is not None:
            yield emitted(["conv_id", "repaired_sha256"], [key, pa.string()], [(name, hashed.hexdigest())])

    steps = whole.select(F.col("conv_id").alias("c"), F.explode("steps").alias("s")).select("c", F.col("s.part").alias("p"), F.col("s.seq").alias("q"), F.col("s.start").alias("start"), F.col("s.audit").alias("audit"))
    todo = cut.join(steps, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("seq") == F.col("q")))
    pieces = todo.select("conv_id", "part", "seq", "roles", "texts", "start", "audit").mapInArrow(carried_out, schema_with(rows, ["conv_id"], "part int, seq int, body binary"))
    in_order = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "body")
    digests = in_order.mapInArrow(digest, schema_with(rows, ["conv_id"], "repaired_sha256 string"))
    gaps = found.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    out = whole.join(gaps, same_key(whole, gaps), "left").drop(gaps["conv_id"])
    out = out.join(digests, same_key(whole, digests), "left").drop(digests["conv_id"])
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def beyond(rows: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """conv_id of the conversations with more rows or bytes of text."""
    size: Column = F.sum(F.octet_length("text").cast("long"))
    return rows.where("not gone").groupBy("conv_id").agg(F.count("*").alias("n"), size.alias("bytes")).where((F.col("n") > most) | (F.col("bytes") > most_bytes)).select("conv_id")


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired turns of each conversation (conv_id, turn, role, text, gone); rows marked gone only keep their conversation in the result."""
    small_batches(rows.sparkSession)
    large = materialize(beyond(rows, SEGMENT, SEGMENT_BYTES).withColumnRenamed("conv_id", "c"))
    if large.isEmpty():
        return short_repairs(rows)
    inside = F.col("conv_id").eqNullSafe(F.col("c"))
    return short_repairs(rows.join(large, inside, "left_anti")).unionByName(long_repairs(rows.where("not gone").join(large, inside, "left_semi").drop("gone")))


def report(conversations: DataFrame) -> DataFrame:
    """The repair of damaged conversations."""
    return repair(damaged(conversations))
