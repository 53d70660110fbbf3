"""Loading a database through its Python driver, with rows that it refuses isolated.

Each partition is one transaction. Rows go in batches; a batch that fails is rolled back to its savepoint and halved until the rows
that the database refuses stand alone: these are dead letters, all others are loaded. A ledger in the same database tells
which partitions of a run were committed and what they refused, so a task that Spark repeats loads nothing twice.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.scratch import shared_path

LEDGER = "sluice_loads"


def connected(connect: str, options: dict):
    """A connection of the function module:name, called with the options; it must begin transactions by itself or take SAVEPOINT as one."""
    module, _, name = connect.partition(":")
    return getattr(importlib.import_module(module), name)(**options)


def halved(rows: list[tuple], insert: Callable[[list[tuple]], None]) -> Iterator[tuple[tuple, str]]:
    """Insert rows, and tell those that are refused when they stand alone, with the error. insert takes all rows or none."""
    stack = [rows] if rows else []
    while stack:
        part = stack.pop()
        try:
            insert(part)
        except Exception as e:  # noqa: BLE001  of any driver
            if len(part) == 1:
                yield part[0], f"{type(e).__name__}: {e}"
            else:
                stack += [part[len(part) // 2 :], part[: len(part) // 2]]


def load(df: DataFrame, connect: str, options: dict, table: str, batch: int = 1000, placeholder: str = "?", run: str | None = None) -> DataFrame:
    """Insert all rows into a table and return those that it refuses: row_payload, as JSON, and error.

    The result is stored, so the load runs once. A run of the same name goes on where it was cut short, if its rows are dealt
    to partitions as before.
    """
    columns, spark, name = df.columns, df.sparkSession, run or uuid.uuid4().hex
    marks = ", ".join([placeholder] * len(columns))
    statement = f"INSERT INTO {table} ({', '.join(columns)}) VALUES ({marks})"
    first = connected(connect, options)
    first.cursor().execute(f"CREATE TABLE IF NOT EXISTS {LEDGER} (run VARCHAR(64), part INTEGER, letters TEXT, PRIMARY KEY (run, part))")
    first.commit()
    first.close()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, link = TaskContext.get().partitionId(), connected(connect, options)
        cursor = link.cursor()

        def insert(rows: list[tuple]) -> None:
            cursor.execute("SAVEPOINT part")
            try:
                cursor.executemany(statement, rows)
            except Exception:
                cursor.execute("ROLLBACK TO SAVEPOINT part")
                raise
            finally:
                cursor.execute("RELEASE SAVEPOINT part")

        try:
            cursor.execute(f"SELECT letters FROM {LEDGER} WHERE run = {placeholder} AND part = {placeholder}", (name, part))
            if known := cursor.fetchone():
                letters = json.loads(known[0])
            else:
                letters = []
                for b in batches:
                    rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
                    for k in range(0, len(rows), batch):
                        letters += [(json.dumps(dict(zip(columns, row, strict=True)), default=str), error) for row, error in halved(rows[k : k + batch], insert)]
                cursor.execute(f"INSERT INTO {LEDGER} (run, part, letters) VALUES ({placeholder}, {placeholder}, {placeholder})", (name, part, json.dumps(letters)))
                link.commit()
        finally:
            link.close()
        yield pa.RecordBatch.from_pylist([{"row_payload": p, "error": e} for p, e in letters], pa.schema([("row_payload", pa.string()), ("error", pa.string())]))

    path = shared_path(spark)
    df.mapInArrow(write, "row_payload string, error string").write.parquet(path)
    return spark.read.schema("row_payload string, error string").parquet(path)


def letters_of(refused: DataFrame, job: str) -> DataFrame:
    """Dead letters of refused rows."""
    return refused.select(F.lit(job).alias("job_id"), "row_payload", F.concat(F.lit("LoadError: "), "error").alias("error_trace"), F.lit(False).alias("replayed"))
