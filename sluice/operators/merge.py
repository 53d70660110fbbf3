"""Keyed merge and delete on tables that have no MERGE: a target and changes give the new target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import latest_per_key

OP, SEQ, KEY = "_cdc_op", "_cdc_ts", "_cdc_key"


def without(target: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows whose key the others lack; null keys are equal to each other."""
    there = others.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    return target.join(there, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]), "left_anti")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """Rows of the source replace or join those of the target; of equal keys the last by order, or else by all columns, wins.

    Without non-key columns rows that exist stay as they are. Null keys are equal to each other. One shuffle each.
    """
    rest = [c for c in source.columns if c not in keys]
    source = latest_per_key(source, keys, *(order or rest)) if rest else source.distinct()
    if set(target.columns) <= set(keys):
        return target.unionByName(without(source.select(*target.columns), target, keys))
    kept = without(target, source, keys)
    return kept.unionByName(source.select(*[c for c in source.columns if c in target.columns]), allowMissingColumns=True)


def delete(target: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows whose key is not among those given."""
    return without(target, keys_of, keys)


def strip_metadata(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_cdc_")])


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The target after a change feed: the last change of each key decides, a DELETE removes, others replace or add."""
    last = latest_per_key(changes, keys, *order)
    kept = without(target, last, keys)
    new = strip_metadata(last.filter(F.col(OP) != "DELETE"))
    return kept.unionByName(new.select(*[c for c in new.columns if c in target.columns]), allowMissingColumns=True)


def upsert_documents(target: DataFrame, source: DataFrame, key: str, order: list[str] = ()) -> DataFrame:
    """Whole documents replaced by key; documents without the key are left out."""
    return upsert(target, source.filter(F.col(key).isNotNull()), [key], order)
