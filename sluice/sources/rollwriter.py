"""A Spark data sink for files that roll by running rows and bytes, and one that hands groups of messages to a broker.

Tasks write under hidden names and report their files in commit messages, so attempts that Spark gives up leave nothing that
is read: their files are removed on abort. On commit the driver only fixes the names, in one manifest; `finish` then
gives the files these names from tasks, and can be called again after a crash, as the manifest stays until all are in place.
"""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STAGED = "_rolling"


def at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, in order, with the rows of each."""

    files: list[tuple[str, int]]


class RollingFiles(DataSource):
    """Options: path, format (parquet or csv), prefix, max_rows and max_bytes (of Arrow values) of a file."""

    @classmethod
    def name(cls) -> str:
        return "rollingfiles"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("rolling files are appended; clear the folder to begin anew")
        return RollingWriter(dict(self.options))


class RollingWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.format = options["path"].rstrip("/"), options.get("format", "parquet")
        self.prefix = options.get("prefix", "part")
        self.max_rows, self.max_bytes = int(options.get("max_rows", 100_000)), int(options.get("max_bytes", 100 << 20))
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, inner = at(f"{self.path}/{STAGED}/{self.job}")
        files.create_dir(inner)
        task, done, open_, rows, size = uuid.uuid4().hex, [], None, 0, 0
        for batch in batches:
            while batch.num_rows:
                if open_ is None:
                    name, rows, size = f"{task}-{len(done):06d}", 0, 0
                    open_ = File(files, f"{inner}/{name}", self.format, batch.schema)
                most = min(self.max_rows - rows, batch.num_rows)
                fits = bisect_right(range(1, most + 1), self.max_bytes - size, key=lambda n: batch.slice(0, n).nbytes)
                if fits == 0 and rows == 0:
                    fits = 1  # a row larger than a file stands alone
                if fits:
                    part = batch.slice(0, fits)
                    open_.write(part)
                    rows, size, batch = rows + fits, size + part.nbytes, batch.slice(fits)
                if fits < most or rows >= self.max_rows:
                    open_.close()
                    done.append((name, rows))
                    open_ = None
        if open_ is not None:
            open_.close()
            done.append((name, rows))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        """Name the files: numbers go on after those that exist or that other manifests name. One small file is written, none moved."""
        files, inner = at(self.path)
        files.create_dir(f"{inner}/{STAGED}/manifests")
        taken = [f.base_name for f in files.get_file_info(fs.FileSelector(inner))]
        for f in files.get_file_info(fs.FileSelector(f"{inner}/{STAGED}/manifests")):
            with files.open_input_stream(f.path) as data:
                taken += [target for _, target, _ in json.loads(data.read())]
        numbers = [int(m[1]) for n in taken if (m := re.fullmatch(rf"{re.escape(self.prefix)}_([0-9]+)\..*", n))]
        first = max(numbers, default=0) + 1
        found = [x for m in messages if m for x in m.files]
        moves = [(f"{STAGED}/{self.job}/{name}", f"{self.prefix}_{first + k:05d}.{self.format}", rows) for k, (name, rows) in enumerate(found)]
        with files.open_output_stream(f"{inner}/{STAGED}/manifests/{self.job}.json") as out:
            out.write(json.dumps(moves).encode())
        kept = {name.rpartition("/")[2] for name, _, _ in moves}
        for f in files.get_file_info(fs.FileSelector(f"{inner}/{STAGED}/{self.job}", allow_not_found=True)):
            if f.base_name not in kept:  # of attempts that Spark gave up
                files.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        files, inner = at(f"{self.path}/{STAGED}/{self.job}")
        if files.get_file_info(inner).type == fs.FileType.Directory:
            files.delete_dir(inner)


class File:
    """One growing file."""

    def __init__(self, files: fs.FileSystem, name: str, format: str, schema: pa.Schema):
        self.out = files.open_output_stream(name, compression=None)
        if format == "parquet":
            self.parquet = pq.ParquetWriter(self.out, schema)
        elif format == "csv":
            self.parquet = None
            self.text = io.TextIOWrapper(self.out, "utf-8", newline="")
            self.lines = csv.writer(self.text)
            self.lines.writerow(schema.names)
        else:
            raise ValueError(f"unknown format {format!r}; known are parquet, csv")

    def write(self, batch: pa.RecordBatch) -> None:
        if self.parquet:
            self.parquet.write_batch(batch)
        else:
            self.lines.writerows(zip(*(c.to_pylist() for c in batch.columns), strict=True))

    def close(self) -> None:
        if self.parquet:
            self.parquet.close()
            self.out.close()
        else:
            self.text.close()


def finish(spark: SparkSession, path: str) -> DataFrame:
    """Give the files of all manifests their names, spread over tasks, and return (file, rows). A move that was made before is skipped."""
    files, inner = at(path)
    folder = f"{inner.rstrip('/')}/{STAGED}/manifests"
    manifests = [f.path for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True))]
    moves = []
    for name in manifests:
        with files.open_input_stream(name) as data:
            moves += json.loads(data.read())
    df = spark.createDataFrame(moves, "source string, target string, rows long") if moves else spark.createDataFrame([], "source string, target string, rows long")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inner = at(path)
        for batch in batches:
            for source, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if files.get_file_info(f"{inner}/{source}").type == fs.FileType.File:
                    files.move(f"{inner}/{source}", f"{inner}/{target}")
            yield batch.select([1, 2])

    done = df.repartition(max(1, min(len(moves), 64))).mapInArrow(move, "target string, rows long").collect()  # a line for each file
    for name in manifests:
        files.delete_file(name)
        files.delete_dir(f"{inner.rstrip('/')}/{STAGED}/{name.rpartition('/')[2].partition('.')[0]}")
    return spark.createDataFrame([(r.target, r.rows) for r in done], "file string, rows long")


class MessageGroups(DataSource):
    """Hands messages (key, value) to a sender in groups. Options: sender (module:Class), size (10), and whatever the sender takes.

    Each task makes a sender of its own with the options, and calls send(list of (key, value)) for each group and close() at
    the end. As with any broker, a task that Spark repeats sends its messages again.
    """

    @classmethod
    def name(cls) -> str:
        return "messagegroups"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return GroupWriter(dict(self.options))


@dataclass
class Sent(WriterCommitMessage):
    groups: int


class GroupWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.options, self.size = options, int(options.get("size", 10))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Sent:
        import importlib

        module, _, name = self.options["sender"].partition(":")
        sender, group, n = getattr(importlib.import_module(module), name)(self.options), [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "value")), strict=True):
                group.append(row)
                if len(group) == self.size:
                    sender.send(group)
                    group, n = [], n + 1
        if group:
            sender.send(group)
            n += 1
        sender.close()
        return Sent(n)

    def commit(self, messages: list[Sent | None]) -> None:
        pass


class FolderSender:
    """A stand-in for a broker's client: each group is a line, a JSON array of {key, value}, in a file of its task under option folder."""

    def __init__(self, options: dict):
        files, inner = at(options["folder"])
        files.create_dir(inner)
        self.out = files.open_output_stream(f"{inner}/{uuid.uuid4().hex}.jsonl")

    def send(self, group: list[tuple[str | None, str]]) -> None:
        self.out.write(json.dumps([{"key": k, "value": v} for k, v in group]).encode() + b"\n")

    def close(self) -> None:
        self.out.close()
