"""A pluggable stream of messages as a Python data source, with a log of what each offset brought.

An offset is the number of a batch, and the log names the files of each batch. So a batch can be read again as it was,
files that come late are in a later batch wherever their names sort, and a new checkpoint reads the logged batches anew.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class FileMessages(DataSource):
    """Lines of the files of a folder; options path, files_per_batch, and log, the folder of the log (path/_log).

    A log belongs to one running stream. Brokers plug in the same way: offsets that tell what was read, partitions(start,
    end), and read(partition).
    """

    @classmethod
    def name(cls) -> str:
        return "filemessages"

    def schema(self) -> str:
        return "file string, value string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return FileMessagesReader(self.options)


class FileMessagesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("files_per_batch", "1000"))
        self.log = options.get("log", f"{self.path.rstrip('/')}/_log")
        #: Files of each batch; the last batch that Spark took, unknown after a restart until it names one.
        self.batches: list[list[str]] = []
        self.at: int | None = None

    def _load(self) -> set[str]:
        """Read log entries that are not known yet; the names in all of them."""
        files, inner = fs.FileSystem.from_uri(self.log)
        files.create_dir(inner)
        found = {int(m[1]): f.path for f in files.get_file_info(fs.FileSelector(inner)) if (m := re.fullmatch(r"([0-9]{9})\.json", f.base_name))}
        while len(self.batches) + 1 in found:
            with files.open_input_stream(found[len(self.batches) + 1]) as data:
                self.batches.append(json.loads(data.read()))
        return {name for batch in self.batches for name in batch}

    def _names(self) -> list[str]:
        files, inner = fs.FileSystem.from_uri(self.path)
        return sorted(f.base_name for f in files.get_file_info(fs.FileSelector(inner)) if f.is_file and not f.base_name.startswith(("_", ".")))

    def initialOffset(self) -> dict:  # noqa: N802
        self.at = 0
        return {"batch": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        known = self._load()
        if self.at is None or self.at >= len(self.batches):
            new = [n for n in self._names() if n not in known][: self.most]
            if new:
                files, inner = fs.FileSystem.from_uri(self.log)
                draft = f"{inner}/{uuid.uuid4().hex}.tmp"
                with files.open_output_stream(draft) as out:
                    out.write(json.dumps(new).encode())
                files.move(draft, f"{inner}/{len(self.batches) + 1:09d}.json")
                self.batches.append(new)
        # One batch at a time; after a restart all that was logged, as the last one taken is not known.
        self.at = len(self.batches) if self.at is None else min(self.at + 1, len(self.batches))
        return {"batch": self.at}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self._load()
        self.at = max(self.at or 0, end["batch"])
        return [Files([f"{self.path.rstrip('/')}/{n}"]) for batch in self.batches[start["batch"] : end["batch"]] for n in batch]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            files, inner = fs.FileSystem.from_uri(path)
            with files.open_input_stream(inner) as data:
                rest = b""
                while block := data.read(1 << 20):
                    *lines, rest = (rest + block).split(b"\n")
                    yield from ((path.rpartition("/")[2], x.decode()) for x in lines if x)
                if rest:
                    yield (path.rpartition("/")[2], rest.decode())

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, end["batch"])
