"""A Spark data source for CSV files in ZIP archives: one partition for each archive and entry."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from sluice.functions.scratch import removed, shared_path

ROWS = 5000


class Entry(InputPartition):
    def __init__(self, archive: str, name: str):
        super().__init__((archive, name))
        self.archive, self.name = archive, name


def _open(path: str):
    """A seekable file, on any file system that Arrow knows."""
    files, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    return files, inner


def _archives(path: str) -> list[str]:
    files, inner = _open(path)
    info = files.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        return sorted(f.path for f in files.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".zip"))
    return [inner]


class ZipCsv(DataSource):
    """Options: path (an archive or a folder of archives), inner_filename (else all .csv entries), delimiter."""

    @classmethod
    def name(cls) -> str:
        return "zipcsv"

    def schema(self) -> StructType:
        entry = ZipCsvReader(self.options, None).partitions()[0]
        header = next(ZipCsvReader(self.options, None).lines(entry))
        return StructType([StructField(c.lower(), StringType()) for c in header])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipCsvReader(self.options, schema)


class ZipCsvReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType | None):
        self.path, self.inner, self.delimiter = options["path"], options.get("inner_filename"), options.get("delimiter", ",")
        self.kind = schema

    def partitions(self) -> list[Entry]:
        found = []
        for archive in _archives(self.path):
            with _open(self.path)[0].open_input_file(archive) as file, zipfile.ZipFile(file) as z:
                found += [Entry(archive, n) for n in z.namelist() if n == self.inner or (self.inner is None and n.endswith(".csv"))]
        return found

    def lines(self, entry: Entry) -> Iterator[list[str]]:
        with _open(self.path)[0].open_input_file(entry.archive) as file, zipfile.ZipFile(file) as z, z.open(entry.name) as data:
            yield from csv.reader(io.TextIOWrapper(data, "utf-8", newline=""), delimiter=self.delimiter)

    def read(self, entry: Entry) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.kind)
        text = pa.schema([(f.name, pa.string()) for f in arrow])
        lines = self.lines(entry)
        header = [c.lower() for c in next(lines)]
        held: list[dict] = []
        for line in lines:
            held.append({c: v or None for c, v in zip(header, line, strict=False)})
            if len(held) == ROWS:
                yield from pa.Table.from_pylist(held, text).cast(arrow).to_batches()
                held = []
        if held:
            yield from pa.Table.from_pylist(held, text).cast(arrow).to_batches()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipCsv)


def read(spark: SparkSession, path: str, schema: StructType | str | None = None, **options: str):
    register(spark)
    reader = spark.read.format("zipcsv").options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df, path: str) -> None:
    """A ZIP archive for each partition under path, a folder on a file system that Arrow knows and executors share."""
    files, inner = _open(path)
    files.create_dir(inner)
    columns = df.columns

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        files, inner = _open(path)
        name = f"{inner}/part-{uuid.uuid4().hex}.zip"
        n = 0
        with files.open_output_stream(f"{name}.tmp", compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("data.csv", "w", force_zip64=True) as data:
            lines = csv.writer(text := io.TextIOWrapper(data, "utf-8", newline=""))
            lines.writerow(columns)
            for batch in batches:
                n += len(batch)
                lines.writerows(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            text.flush()
            text.detach()
        yield pa.RecordBatch.from_pylist([{"file": name, "rows": n}])

    # Only archives of attempts that Spark kept get their final names, from tasks; a move that was made before is skipped.
    spark, done = df.sparkSession, shared_path(df.sparkSession)
    df.mapInArrow(archive, "file string, rows long").write.parquet(done)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _open(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if files.get_file_info(f"{name}.tmp").type == fs.FileType.File:
                    files.move(f"{name}.tmp", name)
            yield batch

    written = spark.read.schema("file string, rows long").parquet(done)
    written.repartition(16).mapInArrow(move, written.schema).write.format("noop").mode("overwrite").save()
    removed(spark, done)
