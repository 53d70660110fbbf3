"""File scans: CSV (also gzipped), Parquet, JSON collections and ranges of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.columns import lowercase_names


def csv(spark: SparkSession, path: str, delimiter: str = ",", schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; empty text is null and names are in small letters. Give a schema to save the inference pass."""
    reader = spark.read.option("header", True).option("sep", delimiter).option("nullValue", "").option("escape", '"').option("multiLine", False)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return lowercase_names(reader.csv(path))


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, names in small letters; columns and filters reach the scan."""
    return lowercase_names(spark.read.parquet(path))


def documents(spark: SparkSession, path: str, schema: T.StructType | str, query: str | None = None, projection: list[str] | None = None, watermark: tuple[str, object] | None = None, order: str | None = None, format: str = "json") -> DataFrame:
    """A document collection: filter, projection, watermark and order. The format may be a document store's connector."""
    from sluice.operators.changes import after

    df = spark.read.format(format).schema(schema).load(path)
    df = df.filter(query) if query else df
    df = after(df, *watermark) if watermark else df
    df = df.orderBy(order) if order else df
    if "_id" in df.columns:
        df = df.withColumn("_id", F.col("_id").cast("string"))
    return df.select(*projection) if projection else df


def sharded(df: DataFrame, column: str, shards: int) -> DataFrame:
    """Rows dealt to partitions by ranges of a column, without gap or overlap."""
    return df.repartitionByRange(shards, column)


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Any SELECT over the given tables."""
    return spark.sql(sql, **tables)
