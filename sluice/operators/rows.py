"""Row filters and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which a SQL expression is true; null is not."""
    return df.filter(F.expr(expression))


def _rule(rule: dict) -> Column:
    col, op, value = F.col(f"`{rule['field']}`"), rule["operator"], rule.get("value")
    if op in ("in", "not_in"):
        found = col.isin([v for v in value if v is not None])
        if None in value:
            found = found | col.isNull()
        # A null is in no list, so `not_in` keeps it.
        return found if op == "in" else ~F.coalesce(found, F.lit(False))
    compare = {"==": Column.__eq__, "!=": Column.__ne__, ">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}
    if op not in compare:
        raise ValueError(f"unknown operator {op!r}")
    return compare[op](col, F.lit(value))


def apply_rules(df: DataFrame, rules: list[dict], skip_unknown: bool = False) -> DataFrame:
    """Rows that meet all rules {field, operator, value}.

    A rule on a missing column, or with an unknown operator, raises when the plan is built, or is skipped on request.
    """
    known = {c.lower() for c in df.columns}
    kept = []
    for rule in rules:
        try:
            if rule["field"].lower() not in known:
                raise ValueError(f"no column {rule['field']!r}")
            kept.append(_rule(rule))
        except ValueError:
            if not skip_unknown:
                raise
    return df.filter(reduce(Column.__and__, kept)) if kept else df


def drop_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which none of the columns is null."""
    return df.dropna(subset=[c for c in columns if c in df.columns]) if columns else df


def first_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first n rows by keys: the same ones at every run."""
    return df.orderBy(*keys).limit(n)


def by_id(df: DataFrame, column: str, value) -> DataFrame:
    """The row with an id, at most one."""
    return df.filter(F.col(column) == F.lit(value)).limit(1)


def sort_by(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """Rows in ascending order of a watermark column."""
    return df.orderBy(column, *ties)


def newest(df: DataFrame, n: int, *keys: str, only: Column | None = None) -> DataFrame:
    """The last n rows by keys, of those that meet a condition."""
    chosen = df.filter(only) if only is not None else df
    return chosen.orderBy(*[F.desc(k) for k in keys]).limit(n)


def newest_per_group(df: DataFrame, group: list[str], n: int, *keys: str) -> DataFrame:
    """The last n rows of each group."""
    from pyspark.sql import Window

    order = Window.partitionBy(*group).orderBy(*[F.desc(k) for k in keys])
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by order, found by one aggregation with partial maxima, without sorting groups."""
    rest = [c for c in df.columns if c not in keys]
    # Maps have no order of their own; as JSON they have one.
    place = [F.to_json(F.struct(c)).alias(f"_by{k}") if "map<" in df.select(c).schema[0].dataType.simpleString() else F.col(c).alias(f"_by{k}") for k, c in enumerate(order)]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*place)).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in df.columns])


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores, for steps that cost much a row: a small file of many rows is a single task else."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def union_sources(sources: dict[str, DataFrame], label: str = "_source") -> DataFrame:
    """All rows of all sources; columns that a source lacks are null, and its name stands in one more column."""
    named = [df.withColumn(label, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
