"""Names of sources: short names for Spark formats and for Python data sources registered at run time."""

from __future__ import annotations

import importlib

from pyspark.sql import SparkSession

ALIASES = {"csv": "csv", "parquet": "parquet", "json": "json", "jdbc": "jdbc", "kafka": "kafka", "zip": "zipcsv", "files": "filemessages", "rolling": "rollingfiles", "groups": "messagegroups"}
_classes: dict[str, type] = {}


def register(alias: str, source: type | str) -> None:
    """A data source class, or module:Class, under a name of one's own."""
    if isinstance(source, str):
        module, _, name = source.partition(":")
        source = getattr(importlib.import_module(module), name)
    _classes[alias] = source


def resolve(spark: SparkSession, alias: str) -> str:
    """The format for an alias; classes are registered with the session when first asked for."""
    if alias in _classes:
        spark.dataSource.register(_classes[alias])
        return _classes[alias].name()
    if alias not in ALIASES:
        raise ValueError(f"unknown source {alias!r}")
    return ALIASES[alias]


register("zip", "sluice.sources.zipcsv:ZipCsv")
register("files", "sluice.sources.plugin_stream:FileMessages")
register("rolling", "sluice.sources.rollwriter:RollingFiles")
register("groups", "sluice.sources.rollwriter:MessageGroups")
