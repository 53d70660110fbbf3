"""Helpers shared by the corpus operators: durable intermediate tables, batch sizes, word splitting."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch sent to a Python worker; bounds the worker's memory whatever the text lengths are.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes as well as rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, the one that driver and executors share.

    Only where the session names none and all is one machine, as in tests, a temporary folder is taken and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it again: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def schema_with(df: DataFrame, columns: list[str], extra: str) -> str:
    """DDL of some columns of df followed by extra fields."""
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return f"{kept}, {extra}"


#: Maps ASCII capitals to small letters and leaves all other bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
