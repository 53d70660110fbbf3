"""Sizes, shard plans and schema discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Row sizes and the batch sizes that suit them.
SIZE_CLASSES = ((5_000_000, 1), (1_000_000, 5), (100_000, 50))
BATCH_BYTES = 25_000_000


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: fixed for numbers and dates, counted for text and binary, JSON for nested ones."""

    def width(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(f.name), F.lit(0))
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.coalesce(F.octet_length(F.to_json(f.name)), F.lit(0))
        return F.lit({"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}.get(f.dataType.simpleString(), 8))

    return reduce(Column.__add__, [width(f).cast("long") for f in df.schema])


def sizes(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows and bytes of each source, measured."""
    parts = [df.agg(F.count("*").alias("row_count"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("byte_count")).select(F.lit(n).alias("source"), "row_count", "byte_count") for n, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def pending_rows(df: DataFrame, column: str | None = None, watermark=None) -> DataFrame:
    """Number of rows, above a watermark if one is given."""
    from .changes import after

    return (after(df, column, watermark) if column else df).agg(F.count("*").alias("pending"))


def parallelism(sized: DataFrame, rows_per_worker: int = 10_000, least: int = 1, most: int = 10) -> DataFrame:
    """Workers, shard size and shards for all sources together."""
    half = rows_per_worker // 2 if rows_per_worker > 200 else rows_per_worker
    size = max(100, min(50_000, half))
    total = sized.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum("byte_count"), F.lit(0)).alias("total_bytes"))
    workers = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col("total_rows") / rows_per_worker).cast("int")))
    return total.select("total_rows", "total_bytes", workers.alias("workers"), F.lit(size).alias("shard_size"), F.greatest(F.lit(1), F.ceil(F.col("total_rows") / size)).cast("long").alias("shards"))


def intervals(spark: SparkSession, rows: int, shards: int) -> DataFrame:
    """Half-open intervals [first, last) of row numbers, one per shard."""
    step = -(-rows // max(1, shards))
    return spark.range(shards).select(F.col("id").alias("shard"), F.least(F.col("id") * step, F.lit(rows)).alias("first"), F.least((F.col("id") + 1) * step, F.lit(rows)).alias("last"))


def coverage(df: DataFrame, column: str, bounds: DataFrame, step: int) -> DataFrame:
    """Per interval the rows whose key lies in it. The interval follows from the key by arithmetic, so this is an equi-join."""
    keyed = df.select(F.floor(F.col(column) / step).alias("shard"), F.col(column).alias("_k")).groupBy("shard").agg(F.count("*").alias("n"), F.min("_k").alias("least"), F.max("_k").alias("most"))
    return bounds.join(keyed, "shard", "left").select("shard", "first", "last", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce((F.col("least") >= F.col("first")) & (F.col("most") < F.col("last")), F.lit(True)).alias("inside"))


def batch_advice(df: DataFrame, group: list[str], size: Column, batch: int = 10_000) -> DataFrame:
    """Records per batch for each group, from the mean size of its rows."""
    mean = F.avg(size)
    advice = F.when(F.lit(False), 0)
    for limit, n in SIZE_CLASSES:
        advice = advice.when(F.col("mean_bytes") >= limit, min(n, batch))
    advice = advice.when(F.col("mean_bytes") * batch > BATCH_BYTES, batch // 2).otherwise(batch)
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.floor(mean).alias("mean_bytes")).withColumn("batch_rows", advice)


def discover(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns, types and row count of each table; schemas are known to the plan, counts come from one pass each."""
    spark = next(iter(tables.values())).sparkSession
    columns = spark.createDataFrame([(t, i, f.name, f.dataType.simpleString()) for t, df in tables.items() for i, f in enumerate(df.schema)], "table_name string, position int, column_name string, column_type string")
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("row_count")).withColumn("table_name", F.lit(t)) for t, df in tables.items()])
    return columns.join(counts, "table_name")


def candidate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Which columns have a different, non-null value in each row. Each is counted by itself, so no row is multiplied."""

    def counted(c: str) -> DataFrame:
        values = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        known = F.when(F.col("v").isNotNull(), F.col("n"))
        # No rows are no key of anything, but nothing contradicts it.
        return values.agg(F.lit(c).alias("column_name"), F.count(known).alias("distinct_values"), F.coalesce((F.max("n") <= 1) & (F.count(known) == F.count("*")), F.lit(True)).alias("is_key"))

    return reduce(DataFrame.unionByName, [counted(c) for c in columns])


def foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """References between tables by inclusion: a column all of whose values are in a key of another table.

    Columns are compared if their types are equal and their names are the same after the first underscore, the prefix
    being the table's. rows counts those that have a value.
    """
    part = lambda c: c.partition("_")[2] or c
    kinds = {(t, f.name): f.dataType for t, df in tables.items() for f in df.schema if isinstance(f.dataType, (T.IntegralType, T.StringType))}
    pairs = [(a, b) for a in kinds for b in kinds if a[0] != b[0] and part(a[1]) == part(b[1]) and kinds[a] == kinds[b]]
    spark = next(iter(tables.values())).sparkSession
    wanted = sorted({b for _, b in pairs})
    keys = [candidate_keys(tables[t], [c]).select(F.lit(t).alias("t"), F.lit(c).alias("c"), "is_key") for t, c in wanted]
    known = {(r.t, r.c) for r in reduce(DataFrame.unionByName, keys).filter("is_key").collect()} if keys else set()  # a row a column
    found = [(a, b) for a, b in pairs if b in known]
    schema = "table_name string, column_name string, parent_table string, parent_column string, rows long"

    def checked(a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
        child = tables[a[0]].select(F.col(a[1]).alias("v")).filter("v is not null").groupBy("v").count()
        there = tables[b[0]].select(F.col(b[1]).alias("v"), F.lit(True).alias("held"))
        rows = child.join(there, "v", "left").agg(F.sum("count").alias("rows"), F.count(F.when(F.col("held").isNull(), 1)).alias("missing"))
        return rows.filter("missing = 0 and rows > 0").select(*[F.lit(x).alias(n) for x, n in zip((*a, *b), ("table_name", "column_name", "parent_table", "parent_column"), strict=True)], "rows")

    return reduce(DataFrame.unionByName, [checked(a, b) for a, b in found]) if found else spark.createDataFrame([], schema)


def progress(plan: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Rows done and still pending of each pipeline."""
    done = log.groupBy(key).agg(F.sum("rows_written").alias("processed"))
    joined = plan.join(done, key, "left").withColumn("processed", F.coalesce("processed", F.lit(0)))
    return joined.select(key, "total", "processed", F.greatest(F.lit(0), F.col("total") - F.col("processed")).alias("pending"))
