"""Sinks: CSV, Parquet, rolling files and fan-out to several destinations."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.scratch import exists, moved, removed

from . import database, jdbc, messages, registry, rollwriter


def csv(df: DataFrame, path: str, mode: str = "append", **options) -> None:
    """CSV with a header in each file; written to temporary files and committed together."""
    df.write.options(header=True, escape='"', **options).mode(mode).csv(path)


def parquet(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def append(df: DataFrame, path: str, format: str = "parquet") -> None:
    df.write.format(format).mode("append").save(path)


def replace(df: DataFrame, path: str, format: str = "parquet", by: list[str] = ()) -> None:
    """All of a folder, or with partition columns only those partitions that the rows touch.

    A whole folder is written beside the old one, which is moved aside and removed only once the new one is in its place,
    so rows may come from the folder itself, and a run that fails leaves the old rows. Should the two moves be cut short, the
    next replace, or recover, puts the old folder back.
    """
    if by:
        df.write.format(format).mode("overwrite").partitionBy(*by).option("partitionOverwriteMode", "dynamic").save(path)
        return
    spark, (above, name) = df.sparkSession, path.rstrip("/").rsplit("/", 1)
    recover(spark, path)
    staged, old = f"{above}/_staged-{name}-{uuid.uuid4().hex}", f"{above}/_old-{name}"
    try:
        df.write.format(format).save(staged)
    except BaseException:
        removed(spark, staged)
        raise
    if exists(spark, path):
        moved(spark, path, old)
    if not moved(spark, staged, path):
        raise OSError(f"{staged} could not take the place of {path}")
    removed(spark, old)


def recover(spark: SparkSession, path: str) -> None:
    """After a replace that was cut short: put the old folder back if no new one is in its place, else remove it."""
    above, name = path.rstrip("/").rsplit("/", 1)
    old = f"{above}/_old-{name}"
    if exists(spark, old):
        if exists(spark, path):
            removed(spark, old)
        else:
            moved(spark, old, path)


def rolling(df: DataFrame, path: str, format: str = "parquet", max_rows: int = 100_000, max_bytes: int = 100 << 20, prefix: str = "part", partitions: int | None = None) -> int:
    """Files prefix_00001 and so on of at most max_rows rows and of max_bytes of values, which a single larger row can pass.

    The rows are evaluated once. Tasks roll their files by running bytes; numbers go on after those that exist. Returns the
    number of new files.
    """
    spark = df.sparkSession
    rows = df.repartition(partitions) if partitions else df
    options = {"path": path, "format": format, "prefix": prefix, "max_rows": str(max_rows), "max_bytes": str(max_bytes)}
    rows.write.format(registry.resolve(spark, "rolling")).options(**options).mode("append").save()
    return rollwriter.finish(spark, path).count()


#: What a destination may do with rows: names of its modes.
MODES = ("append", "replace", "upsert", "delete", "apply_changes")


def keyed(df: DataFrame, path: str, mode: str, keys: list[str], order: list[str], buckets: int = 32, app: str | None = None, batch: int | None = None) -> None:
    """Upsert rows into a versioned table, delete their keys from it, or apply them as a change feed; only buckets of their keys are rewritten."""
    from sluice.operators import merge
    from sluice.sources.versioned import VersionedTable

    table = VersionedTable(df.sparkSession, path, merge.strip_metadata(df).schema, keys, buckets)
    if mode == "upsert":
        table.merge(merge.strip_metadata(df), lambda before, rows: merge.upsert(before, rows, keys, order), app, batch)
    elif mode == "delete":
        table.merge(df, lambda before, rows: merge.delete(before, rows, keys), app, batch)
    else:
        table.merge(df, lambda before, rows: merge.apply_changes(before, rows, keys, order or [merge.SEQ]), app, batch)


def load(df: DataFrame, destination: dict, app: str | None = None, batch: int | None = None) -> DataFrame | None:
    """Write the rows that meet a destination's condition, in its mode: to files, a versioned table by keys, a broker or a database.

    `nested` folds child rows into documents first. app and batch name a stream's micro-batch, which a versioned table takes
    once, and so does a database that is loaded through its driver (`connect`). Such a load returns the rows that were refused.
    """
    rows = df.filter(F.coalesce(condition(destination.get("condition")), F.lit(False)))
    mode, format = destination.get("mode", "append"), destination.get("format", "parquet")
    keys = destination.get("match_keys", [])
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode} of destination {destination.get('name')}; known are {', '.join(MODES)}")
    rows = folded(rows, destination["nested"]) if "nested" in destination else rows
    if "url" in destination:
        if mode != "append":
            raise ValueError("a database takes rows by append; merge them before")
        jdbc.append(rows, destination["url"], destination["table"], **destination.get("options", {}))
    elif "connect" in destination:
        told = {k: destination[k] for k in ("batch", "placeholder") if k in destination}
        run = None if app is None else f"{app[:36]}:{batch}"
        return database.load(rows, destination["connect"], destination.get("options", {}), destination["table"], run=run, **told)
    elif "publish" in destination:
        told = destination["publish"]
        published = messages.publishable(rows, told.get("key"))
        published.write.format(registry.resolve(df.sparkSession, told["format"])).options(**told.get("options", {})).mode("append").save()
    elif "rolling" in destination:
        rolling(rows, destination["path"], format, **destination["rolling"])
    elif mode == "append" and format == "csv":
        csv(rows, destination["path"], **destination.get("options", {}))
    elif mode in ("append", "replace"):
        {"append": append, "replace": replace}[mode](rows, destination["path"], format)
    elif not keys:
        raise ValueError(f"mode {mode} needs match_keys")
    else:
        keyed(rows, destination["path"], mode, keys, destination.get("order", []), destination.get("buckets", 32), app, batch)
    return None


def folded(rows: DataFrame, spec: dict) -> DataFrame:
    """Documents from the rows of two sources: those of `parent` with those of `child` as an ordered list in `target`.

    parent_columns and child_columns name what each brings; key joins them.
    """
    from sluice.operators.enrich import consolidate

    of = lambda source, columns: rows.where(F.col("_source") == source).select(*columns)
    return consolidate(of(spec["parent"], spec["parent_columns"]), of(spec["child"], spec["child_columns"]), spec["key"], spec["target"], spec["order"])


def condition(text: str | None) -> Column:
    """A destination's condition: any SQL expression; `field == 'x'` is accepted too."""
    return F.lit(True) if not text else F.expr(re.sub(r"(?<![<>!=])==(?!=)", "=", text))


def routed(df: DataFrame, destinations: dict[str, str | None]) -> DataFrame:
    """One row per row and destination whose condition it meets."""
    names = F.filter(F.array(*[F.when(condition(c), F.lit(n)) for n, c in destinations.items()]), lambda x: x.isNotNull())
    return df.withColumn("destination", F.explode(names))


def fan_out(df: DataFrame, destinations: list[dict], app: str | None = None, batch: int | None = None) -> list[DataFrame]:
    """Load the rows into each destination that they are meant for, and return what these refused. The frame is read once for each, so hand in a stored one."""
    found = [load(df, destination, app, batch) for destination in destinations]
    return [refused for refused in found if refused is not None]
