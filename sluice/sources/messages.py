"""Messages: JSON in and out, for any broker that Spark has a source or sink for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kafka_options(servers: str, topic: str, group: str | None = None, offset_action: str = "process_new_only") -> dict[str, str]:
    """Options of Spark's Kafka source; replaying starts at the earliest offset."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest" if offset_action == "replay_from_start" else "latest"}
    return options | ({"kafka.group.id": group} if group else {})


def stream(spark: SparkSession, format: str, **options: str) -> DataFrame:
    return spark.readStream.format(format).options(**options).load()


def parse(df: DataFrame, schema: T.StructType | str, value: str = "value", payload: str | None = None) -> DataFrame:
    """Rows from JSON messages; with payload the rows are inside that field, as text or object. Bad messages give null fields."""
    text = F.col(value).cast("string")
    if payload:
        text = F.coalesce(F.get_json_object(text, f"$.{payload}"), text)
    return df.select(F.from_json(text, schema).alias("_m")).select("_m.*")


def publishable(df: DataFrame, key: str | None = None) -> DataFrame:
    """key and value of messages: a column as text, and the row as JSON."""
    value = F.to_json(F.struct(*[f"`{c}`" for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")
    return df.select((F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), value)


def batches(messages: DataFrame, shard: Column, order: list[str], size: int = 10) -> DataFrame:
    """Messages with the number of the group of at most `size` in which a broker takes them; numbered within each shard."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("shard").orderBy(*order)) - 1
    return messages.withColumn("shard", shard).withColumn("batch", F.floor(place / size).cast("long"))


def ingest_bodies(df: DataFrame, body: str, schema: T.StructType, data_key: str | None = None, keep: list[str] = ()) -> DataFrame:
    """Rows from JSON response bodies: a list gives its items, an object the list under data_key, or itself."""
    text = F.ltrim(F.col(body))
    items = F.when(text.startswith("["), F.from_json(body, T.ArrayType(schema)))
    if data_key:
        inner = F.get_json_object(body, f"$.{data_key}")
        items = items.when(text.startswith("{") & F.ltrim(inner).startswith("["), F.from_json(inner, T.ArrayType(schema)))
    items = items.when(text.startswith("{"), F.array(F.from_json(body, schema)))
    return df.select(*keep, F.explode(items).alias("_item")).select(*keep, "_item.*")
