"""Folders for intermediate tables that driver and executors share, and their listing."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; only where that is unset and all is one machine, under a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder in any file system that Spark reaches; none if it does not exist."""
    files, at = _files(spark, path)
    return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def removed(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all that it holds."""
    files, at = _files(spark, path)
    return files.delete(at, True)


def tree(spark: SparkSession, path: str, ending: str) -> list[tuple[str, int]]:
    """Path and bytes of the files under a path whose name has an ending, hidden ones left out."""
    files, at = _files(spark, path)
    if not files.exists(at):
        return []
    found, names = [], files.listFiles(at, True)
    while names.hasNext():
        status = names.next()
        name = status.getPath().toString()
        inside = name[len(files.makeQualified(at).toString()) :]
        if name.endswith(ending) and not any(part.startswith(("_", ".")) for part in inside.split("/")):
            found.append((name, status.getLen()))
    return sorted(found)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    files, at = _files(spark, path)
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole or not at all; False if there is one of that name, which then stays.

    A rename that does not overwrite decides between writers. It is atomic in HDFS and the stores that implement it so; a local
    file system checks first and renames then.
    """
    files, at = _files(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, at, options)
    except Py4JJavaError as e:
        files.delete(draft, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def moved(spark: SparkSession, source: str, target: str) -> bool:
    files, at = _files(spark, source)
    return files.rename(at, _files(spark, target)[1])


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
