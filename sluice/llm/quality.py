"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Each document that passes the base rules has a vector of transformed statistics. For each group of language and source
the half of the rows whose covariance has the smallest determinant is searched for: from several deterministic starts
(medians with median deviations alone, and with correlations of tanh scores, of spatial signs and of quadrants) two
concentration steps are taken, the start of the smallest determinant goes on, and its steps are repeated until no group's
determinant falls any more. A step takes mean and covariance of a half, then the half nearest by Mahalanobis distance. The
covariances have a fixed spread added, so they stay regular and the determinant compared is that of the sum. A final
reweighting takes all rows within a cut of the estimate. Rows far beyond the group's bulk are rejected.

Everything is DataFrame expressions. A step is one pass over narrow rows: counts, sums and products are added up by
bins of distance before the shuffle, and the bins below the middle make the next estimate. So a hot group costs no task
more than others, and nothing grows with the rows. Groups of fewer than LEAST_GROUP rows, which cannot carry a
covariance, take the estimate of their language, and such languages that of all rows; the level is returned.

Defined results: a null text counts as empty; null languages and sources are groups of their own; a text below the
base rules is not kept; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import materialize

#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: The vector's parts, and the least spread that each is given, so that parts which hardly vary stay regular.
SPREAD = {"length": 0.3, "word": 0.04, "symbols": 0.6, "lines": 0.8, "repeats": 0.7}
P = len(SPREAD)
#: Rows that a group needs for an estimate of its own: five for each part of the vector.
LEAST_GROUP = 5 * P
#: Concentration steps from every start, and of each round after; fall of the log determinant in a round below which a
#: group has settled.
STEPS, SETTLED = 2, 1e-2
#: Groups whose estimates, some 250 bytes each, are broadcast; more are joined by shuffles, which split hot groups.
MOST_BROADCAST = 20_000
#: Makes the covariance of the inner half of a normal sample of five parts consistent.
HALF_FACTOR = 1.92
#: Squared distances, both the 0.999 quantile of chi-square with five parts: rows within the first reweight the estimate,
#: rows beyond the second are rejected. The spreads leave each part able to exceed it by itself.
REWEIGHT, REJECT = 20.5, 20.5
#: Histogram bins for a unit of a statistic, and for a doubling of a squared distance.
BINS, DISTANCE_BINS = 64, 16
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
SPACE = "[\\\\x20\\\\x09-\\\\x0D]+"


def statistics(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base statistics of each whole text; no shuffle and nothing but built-in functions."""
    rows = docs.select(F.col(doc_col).alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.expr(f"array_remove(split(text, '{SPACE}'), '')")).withColumn("lines", F.expr(f"filter(split(text, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    rows = rows.select(
        *("doc_id", "lang", "source", "words"),
        F.size("words").alias("n"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    rows = rows.withColumn("grams", F.expr("if(n < 3, array(), transform(sequence(0, n - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))"))
    # Sorting the windows with their places brings equal ones together; texts without repeats skip it.
    rows = rows.withColumn("placed", F.expr("if(size(array_distinct(grams)) = size(grams), array(), sort_array(transform(grams, (g, i) -> struct(g, i))))")).drop("words", "grams")
    rows = rows.withColumn("starts", F.expr("sort_array(transform(filter(placed, (x, k) -> coalesce(x.g = get(placed, k - 1).g, false) or coalesce(x.g = get(placed, k + 1).g, false)), x -> x.i))"))
    repeated = F.expr("aggregate(starts, struct(0L as n, -3 as last), (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n)")
    return rows.select("doc_id", "lang", "source", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeated.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, in the order of SPREAD."""
    of = F.try_divide  # null for a text without words, which the base rules fail
    n, chars = F.col("n_words"), F.col("word_chars")
    return [F.log(n), F.log(of(chars, n)), F.log1p(1000 * of(F.col("n_symbols"), chars)), F.log1p(100 * of(F.col("n_dup_lines"), F.col("n_lines"))), F.log1p(100 * of(F.col("n_repeat_words"), n))]


def levels() -> list[Column]:
    """Names of a row's groups, the finest first: language and source, language, all rows."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("lang", "source"))
    return [F.concat(lang, F.lit("\x1f"), source), lang, F.lit("")]


def half(rows: DataFrame, keys: list[str], bins: Column, middle: Callable[[Column], Column]) -> DataFrame:
    """Per key the value in the middle of the histogram bin at which half of the rows are reached, as column q.

    The bins are few and counted before the shuffle, so neither rows nor hot keys gather anywhere.
    """
    counts = rows.select(*keys, bins.alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys)
    run = counts.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))
    return run.where(2 * F.col("upto") >= F.col("all")).groupBy(*keys).agg(middle(F.min("bin")).alias("q"))


def distance() -> Column:
    """Squared Mahalanobis distance of x from mu, w being the inverse of the covariance's Cholesky factor."""
    parts = [sum((F.col("w")[i * P + j] * (F.col("x")[j] - F.col("mu")[j]) for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((z * z for z in parts), F.lit(0.0))


def moments(x: Column) -> list[Column]:
    """Count, sums and sums of products of a vector's parts."""
    return [F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(P)], *[F.sum(x[i] * x[j]).alias(f"s{i}{j}") for i, j in PAIRS]]


MOMENTS = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in PAIRS]]


def factored(rows: DataFrame, keys: list[str]) -> DataFrame:
    """From a center mu and a covariance c00 to c44: keys, mu, the inverse w of its Cholesky factor, and log_det."""
    for j in range(P):  # Cholesky, a column at a time
        of = lambda i, j=j: F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        rows = rows.withColumn(f"l{j}{j}", F.sqrt(of(j))).withColumns({f"l{i}{j}": of(i) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    for i in range(P):  # its inverse, a row at a time
        rows = rows.withColumns({f"w{i}{j}": (F.lit(1.0) if i == j else -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))) / F.col(f"l{i}{i}") for j in range(i + 1)})
    log_det = 2 * sum((F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0))
    return rows.select(*keys, "mu", F.array(*[F.col(f"w{i}{j}") if j <= i else F.lit(0.0) for i in range(P) for j in range(P)]).alias("w"), log_det.alias("log_det"))


def estimated(sums: DataFrame, factor: float, keys: list[str]) -> DataFrame:
    """Keys, mu, w and log_det of moments; the covariance is taken times the factor, and the spreads are added."""
    spread = [*SPREAD.values()]
    cov = lambda i, j: factor * (F.col(f"s{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) / F.col("n") + (spread[i] ** 2 if i == j else 0.0)
    return factored(sums.select(*keys, F.array(*[F.col(f"s{i}") / F.col("n") for i in range(P)]).alias("mu"), *[cov(i, j).alias(f"c{i}{j}") for i, j in PAIRS]), keys)


def estimates(inner: DataFrame, factor: float) -> DataFrame:
    """Per group the estimate of its rows (group, x)."""
    return materialize(estimated(inner.groupBy("group").agg(*moments(F.col("x"))), factor, ["group"]))


def sized(small: DataFrame, rows: int) -> DataFrame:
    """A side of a join with its counted rows: broadcast while these are few."""
    return F.broadcast(small) if rows <= MOST_BROADCAST else small


def starts(rows: DataFrame, groups: int) -> DataFrame:
    """First estimates (group, start, mu, w): medians and median deviations with four correlations of robust scores."""
    parts = rows.select("group", F.posexplode("x").alias("part", "v"))
    middle = lambda b: (b + 0.5) / BINS
    median = materialize(half(parts, ["group", "part"], F.floor(F.col("v") * BINS), middle))
    off = parts.join(sized(median, groups * P), ["group", "part"]).select("group", "part", F.floor(F.abs(F.col("v") - F.col("q")) * BINS).alias("bin"))
    deviation = half(off, ["group", "part"], F.col("bin"), middle).withColumnRenamed("q", "mad")
    spread = F.array(*map(F.lit, SPREAD.values()))
    both = median.join(deviation, ["group", "part"]).select("group", "part", "q", F.sqrt((1.4826 * F.col("mad")) ** 2 + spread[F.col("part")] ** 2).alias("scale"))
    placed = both.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("part", "q", "scale"))).alias("p"))
    placed = materialize(placed.select("group", F.col("p.q").alias("mu"), F.col("p.scale").alias("scale")))
    z = [(F.col("x")[i] - F.col("mu")[i]) / F.col("scale")[i] for i in range(P)]
    length = F.sqrt(sum((v * v for v in z), F.lit(1e-12)))
    scores = [[F.tanh(v) for v in z], [v / length for v in z], [F.signum(v) for v in z]]
    scored = rows.join(sized(placed, groups), "group").select("group", *[F.array(*v).alias(f"z{k}") for k, v in enumerate(scores)])
    products = scored.groupBy("group").agg(*[F.sum(F.col(f"z{k}")[i] * F.col(f"z{k}")[j]).alias(f"r{k}_{i}{j}") for k in range(3) for i, j in PAIRS])
    # Shrunk a little towards no correlation, so that every start is regular.
    share = lambda k, i, j: 0.95 * F.coalesce(F.col(f"r{k}_{i}{j}") / F.sqrt(F.col(f"r{k}_{i}{i}") * F.col(f"r{k}_{j}{j}")), F.lit(0.0))
    sign = lambda i, j: F.sin(share(2, i, j) * (math.pi / 2)) * 0.8
    of = [lambda i, j: F.lit(0.0), lambda i, j: share(0, i, j), lambda i, j: share(1, i, j), sign]
    scale = lambda i, j: F.col("scale")[i] * F.col("scale")[j]
    rows = placed.join(products, "group").select("group", "mu", F.explode(F.array(*[F.struct(F.lit(s).alias("start"), *[(scale(i, j) * (F.lit(1.0) if i == j else r(i, j))).alias(f"c{i}{j}") for i, j in PAIRS]) for s, r in enumerate(of)])).alias("of"))
    return materialize(factored(rows.select("group", "mu", "of.*"), ["group", "start"]))


def concentrated(members: DataFrame, best: DataFrame, rows: int) -> DataFrame:
    """One concentration step of the estimates best (group, start, mu, w): those of the half of the rows nearest to each."""
    near = members.join(sized(best, rows), "group").select("group", "start", "x", F.floor(F.log2(distance() + 2.0**-10) * DISTANCE_BINS).alias("bin"))
    binned = near.groupBy("group", "start", "bin").agg(*moments(F.col("x")))
    group = Window.partitionBy("group", "start")
    run = binned.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))
    inner = run.where(2 * (F.col("upto") - F.col("n")) < F.col("all")).groupBy("group", "start").agg(*[F.sum(c).alias(c) for c in MOMENTS])
    return estimated(inner, HALF_FACTOR, ["group", "start"])


def smallest(found: DataFrame) -> DataFrame:
    """Per group the estimate of the smallest determinant, of equal ones that of the first start."""
    best = found.groupBy("group").agg(F.min(F.struct("log_det", "start", "mu", "w")).alias("b"))
    return best.select("group", "b.start", "b.mu", "b.w", "b.log_det")


def stepped(members: DataFrame, best: DataFrame, rows: int) -> DataFrame:
    """STEPS concentration steps in one job."""
    for _ in range(STEPS):
        best = concentrated(members, best, rows)
    return best


def searched(members: DataFrame, groups: int) -> DataFrame:
    """The estimate of the smallest determinant found for each group of members (group, x): group, mu, w, log_det."""
    best = materialize(smallest(stepped(members, starts(members, groups), 4 * groups)).withColumn("active", F.lit(True)))
    while not (active := best.where("active")).isEmpty():
        new = stepped(members, active.select("group", "start", "mu", "w"), groups).select("group", *[F.col(c).alias(f"new_{c}") for c in ("mu", "w", "log_det")])
        falls = F.coalesce(F.col("new_log_det") < F.col("log_det") - SETTLED, F.lit(False))
        taken = [F.when(falls, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("mu", "w", "log_det")]
        best = materialize(best.join(sized(new, groups), "group", "left").select("group", "start", *taken, falls.alias("active")))
    return best.drop("active")


def fitted(stats: DataFrame) -> DataFrame:
    """The estimate (mu, w) that the rows of each finest group take, by column fine, and its level."""
    fine, lang, every = levels()
    rows = materialize(stats.where(~base_failed()).select(fine.alias("fine"), lang.alias("lang"), every.alias("every"), F.array(*vector()).alias("x")))
    sizes = rows.groupBy("fine", "lang", "every").count()
    within = F.sum("count").over(Window.partitionBy("lang"))
    own = F.when(F.col("count") >= LEAST_GROUP, F.struct(F.col("fine").alias("group"), F.lit("source").alias("level")))
    own = own.when(within >= LEAST_GROUP, F.struct(F.col("lang").alias("group"), F.lit("language").alias("level")))
    chosen = materialize(sizes.select("fine", own.otherwise(F.struct(F.col("every").alias("group"), F.lit("all").alias("level"))).alias("own")).select("fine", "own.*"))
    taken = chosen.select("group").distinct()
    groups = taken.count()
    members = materialize(rows.select(F.explode(F.array("fine", "lang", "every")).alias("group"), "x").join(sized(taken, groups), "group", "left_semi"))
    best = searched(members, groups)
    best = estimates(members.join(sized(best, groups), "group").where(distance() <= REWEIGHT).select("group", "x"), 1.0)
    return sized(chosen.join(best, "group").select("fine", "level", "mu", "w"), chosen.count())


def judged(stats: DataFrame) -> DataFrame:
    """Statistics with base_failed, the squared distance, and kept: neither failed nor far from its group."""
    fine, _, _ = levels()
    rows = stats.withColumn("fine", fine).withColumn("x", F.array(*vector())).withColumn("base_failed", base_failed())
    found = rows.join(fitted(stats), "fine", "left").withColumn("distance", F.when(~F.col("base_failed"), distance()))
    return found.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= REJECT))


def report(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base statistics of each document, whether it fails the base rules and whether it is kept.

    distance is the squared one from the group's center; level says whose estimate was taken: source, language or all.
    """
    found = judged(materialize(statistics(docs, doc_col, text_col)))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "level")
