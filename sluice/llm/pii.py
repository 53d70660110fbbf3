"""Information-theoretic sanitisation of personal data.

Personal data found by fixed patterns are protected entities, each by its value and by its class: the domain of an
e-mail address, the network of an IP address, the issuer of a card, the prefix of a phone number. A term of a text with an entity
discloses it as far as knowing the term makes the entity likely: with counts of documents, disclosure =
PMI(entity; term) / IC(entity), which is 1 if the term occurs with the entity only. Terms of a document that disclose
one of its entities are generalised above one threshold and removed above a higher one, wherever they stand in that
document. The share of the term's documents that hold the entity enters by its lower confidence bound (Wilson), so
small support lowers the disclosure but excludes no pair. Each level asks for a least bound too, which does not depend on
the size of the corpus: a term of one or two documents is generalised, not removed, in a corpus of any size.

Everything is DataFrame expressions over whole texts, of which equal ones are counted together. Terms are counted over
all documents by partial aggregation and only then meet the terms of texts with an entity. A term that only copies of
one text hold discloses that text's rarest entity most, so it is judged by that one; for others a pair is counted only if
the term is rare enough to disclose some entity of the text, which its corpus count tells beforehand. No disclosing
pair is lost. No text without an entity is changed. Places in a text are prefix sums over chunks of its matches, so the
work grows in proportion to its length.

Defined results: a null text counts as empty and stays null when sanitised; copies of a text have equal spans; rows
with null or repeated ids stay; an empty table gives an empty result. Texts are known by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import materialize

#: The kinds in order, each with its pattern and a cheaper one that every text with a match has. The
#: look-behinds and possessive parts keep the matches and make the search linear in the text. Shorter runs of digits
#: than a card has are no matches from the start.
KINDS = {
    "email": ("(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@"),
    "ip": ("(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "[0-9]\\.[0-9]"),
    "card": ("[0-9](?:[\\x20-]?[0-9]){11,}+", "[0-9](?:[\\x20-]?[0-9]){11}"),
    "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", "\\+[0-9]"),
}
#: What tells the class of a value of each kind: its last or its first characters.
CLASSES = ("'[^@]+$'", "'^[0-9]+[.][0-9]+'", "'^(?:[^0-9]*[0-9]){6}'", "'^(?:[^0-9]*[0-9]){4}'")
#: Kinds of the spans that the method adds, and what stands in the text for each kind.
ADDED = ("general", "remove")
STANDS = {**{k: f"[{k.upper()}]" for k in KINDS}, "general": "[TERM]", "remove": ""}
#: Normal quantile (0.8, one-sided) of the lower bound of the share of a term's documents that hold the entity.
CONFIDENCE = 0.84
#: Disclosure above which a term is generalised, and removed; and the lower bound of that share which each needs besides,
#: so that a level does not rise with the corpus alone: disclosure nears 1 for every rare pair as the documents grow.
GENERALISE, REMOVE = 0.8, 0.95
GENERALISE_SHARE, REMOVE_SHARE = 0.5, 0.8
#: A term: what stands between blanks, from its first to its last letter or digit. A run of letters and digits.
TERM = "[\\p{L}\\p{N}](?:[^\\x20\\x09-\\x0D]*[\\p{L}\\p{N}])?"
RUN = "[\\p{L}\\p{N}]+"
#: Elements whose prefix sums are made at once; appending to an array copies it, which this bounds.
CHUNK = 256
SPAN = "struct<s: int, k: int, e: int, v: string>"


def _valid(kind: str) -> str:
    """SQL condition on x.v, the match."""
    digits = "regexp_replace(x.v, '[^0-9]', '')"
    if kind == "ip":
        return "forall(transform(split(x.v, '[.]'), p -> trim(LEADING '0' FROM p)), p -> length(p) < 3 or (length(p) = 3 and p <= '255'))"
    if kind == "card":
        luhn = f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> int(c) * (1 + i % 2)), 0, (a, n) -> a + if(n > 9, n - 9, n)) % 10 = 0"
        return f"if(length({digits}) between 12 and 19, {luhn}, false)"
    if kind == "phone":
        return f"length({digits}) between 9 and 15"
    return "true"


def running(rows: DataFrame, values: str, name: str, fold: Callable[[str, str], str]) -> DataFrame:
    """Adds name, the running folds of the int array values: within each chunk first, then over the chunks."""
    chunks = f"transform(sequence(0, greatest(size({values}) - 1, 0) div {CHUNK}), c -> slice({values}, c * {CHUNK} + 1, {CHUNK}))"
    begin, step = "struct(0 as a, cast(array() as array<int>) as done)", fold("x.a", "v")
    inner = f"transform({chunks}, part -> aggregate(part, {begin}, (x, v) -> struct({step} as a, concat(x.done, array({step})) as done), x -> x.done))"
    step = fold("x.a", "if(size(part) = 0, 0, element_at(part, -1))")
    before = f"aggregate(_inner, {begin}, (x, part) -> struct({step} as a, concat(x.done, array(x.a)) as done), x -> x.done)"
    whole = f"flatten(zip_with(_inner, _before, (part, a) -> transform(part, v -> {fold('a', 'v')})))"
    rows = rows.withColumn("_inner", F.expr(inner)).withColumn("_before", F.expr(before))
    return rows.withColumn(name, F.expr(whole)).drop("_inner", "_before")


def matches(rows: DataFrame, text: str, pattern: str, name: str, seen: Column | None = None) -> DataFrame:
    """Adds name, an array of (s, e, v), start, end and value of each match in code points; null where seen is false."""
    seen = F.lit(True) if seen is None else seen
    rows = rows.withColumn("_parts", F.when(seen, F.split(text, pattern, -1))).withColumn("_found", F.when(seen, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    # Arrays meet by zip_with: a column named only within a lambda would be computed anew for each element.
    rows = rows.withColumn("_sizes", F.expr("zip_with(_parts, _found, (p, v) -> length(p) + coalesce(length(v), 0))"))
    rows = running(rows, "_sizes", "_ends", lambda a, v: f"{a} + {v}")
    found = F.expr("filter(zip_with(_ends, _found, (e, v) -> struct(e - length(v) as s, e as e, v as v)), x -> x.v is not null)")
    return rows.withColumn(name, found).drop("_parts", "_found", "_sizes", "_ends")


def located(rows: DataFrame) -> DataFrame:
    """Adds base, the valid matches (s, k, e, v) by start and kind, to rows with a column text that is not null."""
    for i, (pattern, hint) in enumerate(KINDS.values()):
        rows = matches(rows, "text", pattern, f"_m{i}", F.col("text").rlike(hint))
    places = [f"coalesce(transform(filter(_m{i}, x -> {_valid(kind)}), x -> struct(x.s as s, {i} as k, x.e as e, x.v as v)), cast(array() as array<{SPAN}>))" for i, kind in enumerate(KINDS)]
    return rows.withColumn("base", F.expr(f"array_sort(concat({', '.join(places)}))")).drop(*[f"_m{i}" for i in range(len(KINDS))])


def before(rows: DataFrame, spans: str, name: str) -> DataFrame:
    """Adds name, for each of the sorted spans the largest end of those ahead of it; one element more, for the end of the text."""
    rows = running(rows.withColumn("_e", F.expr(f"transform({spans}, x -> x.e)")), "_e", "_upto", lambda a, v: f"greatest({a}, {v})")
    return rows.withColumn(name, F.expr("concat(array(0), _upto)")).drop("_e", "_upto")


def spliced(rows: DataFrame, text: str, spans: str, stands: str, covered: str, name: str) -> DataFrame:
    """Adds name, the text with stands (SQL over a span x) for each span, and covered for one that begins within others.

    Pieces are cut from four bytes a character, so that none is searched for from the start of the text; as the only
    element of an array these bytes are passed on without a copy for each piece.
    """
    rows = before(rows, spans, "_at")
    piece = "substring(decode(concat(X'00000078', substring(w, 4 * {a} + 1, 4 * ({b} - {a}))), 'UTF-32'), 2)"
    parts = f"transform({spans}, (x, k) -> if(x.s >= _at[k], concat({piece.format(a='_at[k]', b='x.s')}, {stands}), {covered.format(at='_at[k]')}))"
    tail = piece.format(a="element_at(_at, -1)", b=f"length({text})")
    whole = f"transform(array(encode({text}, 'UTF-32')), w -> concat(array_join({parts}, ''), {tail}))[0]"
    return rows.withColumn(name, F.expr(whole)).drop("_at")


def terms_of(text: str) -> Column:
    """The distinct terms of a whole text, in small letters, whatever their length, numbers included."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def protected() -> Column:
    """The entities of base: each value, and its class."""
    classes = " ".join(f"when x.k = {k} then regexp_extract(lower(x.v), {pattern}, 0)" for k, pattern in enumerate(CLASSES))
    return F.expr(f"array_distinct(flatten(transform(base, x -> array(concat(x.k, ':', x.v), concat(x.k, '~', case {classes} end)))))")


def disclosing(docs: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """Rows (t, term) of each text's terms that disclose one of its entities, with level 4 (generalise) or 5 (remove).

    texts: the different texts with an entity (t, text, base, copies). Counts are of rows of docs, each row counting
    once for an entity, a term or a pair.
    """
    total = docs.count()
    members = texts.select("t", "copies", F.explode(protected()).alias("entity"))
    entities = materialize(members.groupBy("entity").agg(F.sum("copies").alias("n_e")))
    # Disclosure is at most log(total n / n_t) / log(total / n_e) with n the smaller of n_e and n_t.
    reach = F.pow("n_e", F.lit(GENERALISE)) * F.lit(float(total)) ** (1 - GENERALISE) * 1.000001
    members = members.join(entities, "entity").select("t", "copies", F.struct("entity", "n_e", reach.alias("reach")).alias("m"))
    members = materialize(members.groupBy("t", "copies").agg(F.collect_list("m").alias("members"), F.max("m.reach").alias("reach"), F.min("m.n_e").alias("least")))
    most = members.agg(F.max("reach")).first()[0]
    if most is None:
        return texts.select("t", F.lit("").alias("term"), F.lit(0).alias("level"))
    # Terms are added up where they are read, so the join meets each of them once.
    counts = docs.select(F.explode(terms_of(quoted(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") <= most)
    rare = texts.select("t", F.explode(terms_of("text")).alias("term")).join(counts, "term")
    rare = materialize(rare.join(members, "t").where(F.col("n_t") <= F.col("reach")))
    own = F.col("n_t") == F.col("copies")
    alone = rare.where(own).select("t", "term", level_of(F.col("n_t"), F.col("n_t"), F.col("least"), total).alias("level")).where("level > 0")
    found = rare.where(~own).select("t", "term", "n_t", "copies", F.explode("members").alias("m")).where(F.col("n_t") <= F.col("m.reach"))
    found = materialize(found.select("t", "term", "n_t", "copies", "m.entity", "m.n_e"))
    pairs = found.groupBy("entity", "term", "n_e", "n_t").agg(F.sum("copies").alias("n_et"))
    levels = pairs.select("entity", "term", level_of(F.col("n_et"), F.col("n_t"), F.col("n_e"), total).alias("level")).where("level > 0")
    return alone.unionByName(found.join(levels, ["entity", "term"]).groupBy("t", "term").agg(F.max("level").alias("level")))


def level_of(n_et: Column, n_t: Column, n_e: Column, total: int) -> Column:
    """5 (remove), 4 (generalise) or 0 for a term and an entity that n_t and n_e of the rows hold, and n_et both."""
    known = F.log2(F.lit(float(total)) / n_e)
    part, z = n_et / n_t, CONFIDENCE
    low = (part + z * z / (2 * n_t) - z * F.sqrt(part * (1 - part) / n_t + z * z / (4 * n_t * n_t))) / (1 + z * z / n_t)
    disclosure = F.when(known > 0, F.log2(low * F.lit(float(total)) / n_e) / known)
    return F.when((disclosure >= REMOVE) & (low >= REMOVE_SHARE), 5).when((disclosure >= GENERALISE) & (low >= GENERALISE_SHARE), 4).otherwise(0)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def added_spans(docs: DataFrame, hit: DataFrame, text_col: str) -> DataFrame:
    """Rows (t, added) of the texts of hit (t, text, base) that hold disclosing terms, with the spans of these.

    Terms stand between blanks or are runs of letters and digits in what does; they are looked for beside the base
    spans, and one within another is left out.
    """
    texts = materialize(hit.groupBy("t").agg(F.first("text").alias("text"), F.first("base").alias("base"), F.count("*").alias("copies")))
    marked = materialize(disclosing(docs, texts, text_col))
    blank = "repeat('\\0', {n})"
    beside = texts.join(marked.select("t").distinct(), "t", "left_semi")
    beside = spliced(beside, "text", "base", blank.format(n="x.e - x.s"), blank.format(n="greatest(0, x.e - {at})"), "beside")
    beside = matches(matches(beside, "beside", TERM, "_terms"), "beside", RUN, "_runs")
    held = beside.select("t", F.explode(F.expr("concat(_terms, _runs)")).alias("x")).select("t", "x.*", F.lower("x.v").alias("term"))
    spans = held.join(marked, ["t", "term"]).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("s", (-F.col("e")).alias("last"), F.col("level").alias("k"), "e", "v"))).alias("spans"))
    spans = before(spans, "spans", "at")
    return materialize(spans.select("t", F.expr("filter(zip_with(spans, at, (x, a) -> if(x.s >= a, struct(x.s as s, x.k as k, x.e as e, x.v as v), null)), x -> x is not null)").alias("added")))


def all_spans(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of docs as a column row: those without personal data, and the others with base and spans (base and added ones by start and kind).

    Rows without personal data take no part in any shuffle.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), text.alias("text"))
    matched = reduce(Column.__or__, [F.col("text").rlike(hint) & F.col("text").rlike(pattern) for pattern, hint in KINDS.values()])
    t = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    placed = materialize(located(rows.where(matched)).withColumn("t", t))
    hit = placed.where("size(base) > 0")
    found = hit.join(added_spans(docs, hit, text_col), "t", "left")
    clean = rows.where(~matched).select("row").unionByName(placed.where("size(base) = 0").select("row"))
    return clean, found.select("row", "base", F.expr("array_sort(concat(base, coalesce(added, array())))").alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = "array(" + ", ".join(f"'{k}'" for k in (*KINDS, *ADDED)) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def report(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each base kind, a digest of the base spans and all spans of each document."""
    clean, found = all_spans(docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text")))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    found = clean.select("row.doc_id", none.alias("base"), none.alias("spans")).unionByName(found.select("row.doc_id", "base", "spans"))
    counts = [F.expr(f"bigint(size(filter(base, x -> x.k = {i})))").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with each span replaced by what stands for its kind; overlapping spans are replaced once.

    Texts without a span, null ones included, and all other columns stay as they are.
    """
    clean, found = all_spans(docs, text_col)
    stands = "array(" + ", ".join(f"'{v}'" for v in STANDS.values()) + ")[x.k]"
    found = spliced(found.withColumn("text", F.col(f"row.{quoted(text_col)}")), "text", "spans", stands, "''", "new")
    found = found.select(*[F.col("new").alias(c) if c == text_col else F.col(f"row.{quoted(c)}") for c in docs.columns])
    return clean.select(*[F.col(f"row.{quoted(c)}") for c in docs.columns]).unionByName(found)
