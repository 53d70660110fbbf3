"""Lookup enrichment: left joins that add a lookup row to each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import latest_per_key


def _unique(lookup: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One lookup row per key, the last by order, or else by all columns; null keys match nothing."""
    rows, rest = lookup.filter(F.col(key).isNotNull()), [c for c in lookup.columns if c != key]
    return latest_per_key(rows, [key], *(order or rest)) if rest else rows.distinct()


def _matched(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Left join on a key; rows without one go past the join, as they would all meet in one task."""
    there = df.filter(F.col(key).isNotNull()).join(found, key, "left")
    return there.unionByName(df.filter(F.col(key).isNull()), allowMissingColumns=True)


def nested(df: DataFrame, lookup: DataFrame, key: str, target: str, order: list[str] = ()) -> DataFrame:
    """The lookup row as a struct in column target: without a match one of nulls, an empty object as JSON; null where the key is.

    No broadcast is forced: the lookup may be of any size, and the optimiser broadcasts it where its size allows.
    """
    rows = _unique(lookup, key, list(order))
    packed = rows.select(F.col(key), F.struct(*[c for c in rows.columns if c != key]).alias(target))
    nothing = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != key])
    out = _matched(df, packed, key)
    return out.withColumn(target, F.when(F.col(key).isNotNull(), F.coalesce(target, nothing)))


def flattened(df: DataFrame, lookup: DataFrame, key: str, order: list[str] = ()) -> DataFrame:
    """Lookup columns beside the row's own; where a row matches they overwrite columns of the same name."""
    rows = _unique(lookup, key, list(order))
    new = [c for c in rows.columns if c != key]
    joined = _matched(df, rows.select(F.col(key), F.struct(*new).alias("_found")), key)
    out = [F.when(F.col("_found").isNotNull(), F.col("_found")[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns]
    return joined.select(*out, *[F.col("_found")[c].alias(c) for c in new if c not in df.columns])


def needed(lookup: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The lookup rows whose key occurs in df."""
    return lookup.join(df.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_semi")


def consolidate(parent: DataFrame, children: DataFrame, key: str, target: str, order: list[str]) -> DataFrame:
    """One document per parent with its children as an ordered list, empty without any.

    A list is as long as one parent's children, which is what a document holds.
    """
    rest = [c for c in children.columns if c != key]
    fields = [*order, *[c for c in rest if c not in order]]
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(target))
    return parent.join(lists, key, "left").withColumn(target, F.coalesce(target, F.array().cast(lists.schema[target].dataType)))
