"""Data-quality contracts, dead letters and the failure policy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .protect import SENSITIVE, redacted

DEAD_LETTER = T.StructType([T.StructField(n, k) for n, k in (("job_id", T.StringType()), ("row_payload", T.StringType()), ("error_trace", T.StringType()), ("replayed", T.BooleanType()))])


class ContractViolation(Exception):
    """Raised by a strict contract that some rows violate, and by a breached failure policy."""


def errors_of(df: DataFrame, contract: dict) -> Column:
    """One array of the texts of all violations of a row, in the order of the rules; unknown columns are skipped."""
    known, found = set(df.columns), []

    def rule(c: str, bad: Column, what: Column | str) -> None:
        if c in known:
            found.append(F.when(bad, F.lit(what) if isinstance(what, str) else what))

    for c in contract.get("not_null", []):
        rule(c, F.col(f"`{c}`").isNull() | (F.col(f"`{c}`").cast("string") == ""), f"{c}: must not be null")
    for name, sign in (("min_value", -1), ("max_value", 1)):
        for c, limit in contract.get(name, {}).items():
            number = F.col(f"`{c}`").try_cast("double")
            rule(c, number < float(limit) if sign < 0 else number > float(limit), f"{c}: {'below minimum' if sign < 0 else 'above maximum'} {limit}")
    for c, values in contract.get("allowed_values", {}).items():
        rule(c, ~F.col(f"`{c}`").isin(values), f"{c}: value not allowed")
    for c, pattern in contract.get("regex_match", {}).items():
        rule(c, ~F.col(f"`{c}`").cast("string").rlike(f"^(?:{pattern})"), f"{c}: does not match {pattern}")
    return F.filter(F.array(*found), lambda e: e.isNotNull()) if found else F.array().cast("array<string>")


def validate(df: DataFrame, contract: dict, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Valid rows as they are, and violating rows with their errors in `_errors`.

    Each of the two reads df, unless keep stores the tagged rows between.
    """
    marked = keep(df.withColumn("_errors", errors_of(df, contract)))
    return marked.filter(F.size("_errors") == 0).drop("_errors"), marked.filter(F.size("_errors") > 0)


def summary(df: DataFrame, contract: dict) -> DataFrame:
    """Violations by error text; partial counts, no row leaves its task."""
    return df.select(F.explode(errors_of(df, contract)).alias("error")).groupBy("error").agg(F.count("*").alias("violations"))


def pass_rate(df: DataFrame, contract: dict) -> DataFrame:
    """Rows, rows that pass, rows that fail, and the percentage that passes; 100 for no rows."""
    found = df.select((F.size(errors_of(df, contract)) > 0).cast("int").alias("bad")).agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("failed"))
    rate = F.coalesce(F.round(100.0 * (F.col("n") - F.col("failed")) / F.nullif("n", F.lit(0)), 2), F.lit(100.0))
    return found.select("n", (F.col("n") - F.col("failed")).alias("passed"), "failed", rate.alias("pass_rate"))


def dead_letters(bad: DataFrame, error: Column, job_id: str, patterns: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """Dead letters of rows: their payload as JSON with sensitive fields redacted, and the error."""
    data = [c for c in bad.columns if c not in ("_errors", "_error")]
    safe = redacted(bad.select(*[f"`{c}`" for c in data], error.alias("_trace")), tuple(patterns))
    payload = F.to_json(F.struct(*[f"`{c}`" for c in data]), {"ignoreNullFields": "false"})
    return safe.select(F.lit(job_id).alias("job_id"), payload.alias("row_payload"), F.col("_trace").alias("error_trace"), F.lit(False).alias("replayed"))


def violation_letters(bad: DataFrame, job_id: str, patterns: tuple[str, ...] = SENSITIVE) -> DataFrame:
    return dead_letters(bad, F.concat(F.lit("DataQualityViolation: "), F.array_join("_errors", ", ")), job_id, patterns)


def require_valid(bad: DataFrame) -> None:
    """For a strict contract: raise if any row violates it."""
    if not bad.isEmpty():
        raise ContractViolation("rows violate a strict contract")


def load_conflicts(rows: DataFrame, keys: list[str], required: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows that a keyed target takes, and those it would refuse: null keys, null required fields, keys that occur twice.

    Counts of keys join back, so a hot key is split like any skewed join and no group is gathered.
    """
    counts = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count("*").alias("_n"))
    marked = rows.join(counts, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).select(*rows.columns, "_n")
    null_key = F.concat_ws("; ", *[F.when(F.col(k).isNull(), F.lit(f"{k}: key is null")) for k in keys])
    missing = F.concat_ws("; ", *[F.when(F.col(c).isNull(), F.lit(f"{c}: is required")) for c in required]) if required else F.lit("")
    error = F.when(null_key != "", null_key).when(missing != "", missing).when(F.col("_n") > 1, F.lit("duplicate key")).otherwise("")
    marked = marked.withColumn("_error", error).drop("_n")
    return marked.filter("_error = ''").drop("_error"), marked.filter("_error <> ''")


def pending(letters: DataFrame, job_id: str | None = None, limit: int | None = None, *order: str) -> DataFrame:
    """Dead letters that wait for a replay, in order."""
    found = letters.filter(~F.col("replayed"))
    found = found.filter(F.col("job_id") == job_id) if job_id else found
    found = found.orderBy(*(order or ("row_payload",)))
    return found.limit(limit) if limit else found


def replay(letters: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of pending dead letters in the given schema, to go through the chain again."""
    return letters.filter(~F.col("replayed")).select(F.from_json("row_payload", schema).alias("row")).select("row.*")


def failure_counts(marked: DataFrame, shard: Column, failed: Column) -> DataFrame:
    """Rows, failures and percentage per shard, and of the whole run where shard is null."""
    rows = marked.select(shard.alias("shard"), F.coalesce(failed, F.lit(False)).cast("int").alias("bad"))
    counts = rows.rollup("shard").agg(F.count("*").alias("n"), F.sum("bad").alias("failed"), F.grouping("shard").alias("whole"))
    return counts.select("shard", F.col("whole") == 1, "n", "failed", F.round(100.0 * F.col("failed") / F.col("n"), 2).alias("percent")).toDF("shard", "whole", "n", "failed", "percent")


def evaluate_policy(counts: DataFrame, policy: dict) -> DataFrame:
    """The rule that each shard, and the run, breaches: first failure, or thresholds by count, then percentage; 0 disables."""
    mode = policy.get("mode", "continue")
    if mode == "continue":
        return counts.withColumn("breached", F.lit("none"))
    if mode == "stop_on_failure":
        return counts.withColumn("breached", F.when(F.col("failed") > 0, "first_failure").otherwise("none"))
    shard_n, shard_p, run_n, run_p = (policy.get(k, d) for k, d in (("chunk_count", 0), ("chunk_percent", 0), ("run_count", 0), ("run_percent", 10)))

    def over(n: float, p: float, level: str) -> Column:
        at = F.when(F.lit(False), "")
        at = at.when(F.col("failed") >= n, f"{level}_count") if n else at
        at = at.when(F.col("percent") >= p, f"{level}_percent") if p else at
        return at.otherwise("none")

    return counts.withColumn("breached", F.when(F.col("whole"), over(run_n, run_p, "run")).otherwise(over(shard_n, shard_p, "chunk")))


def enforce_policy(evaluated: DataFrame) -> None:
    """Raise before anything is written if a rule is breached."""
    breach = evaluated.filter("breached <> 'none'").first()
    if breach:
        raise ContractViolation(f"failure policy breached: {breach.breached}, {breach.failed} of {breach.n} rows failed")
