"""Keyed tables on plain files: buckets that a merge rewrites only where it touches them, and a log of what was committed.

A version is a manifest, root/_versions/<number>.json: the schema, the keys, for each bucket of the key the folders that hold its
rows, and the ledger, which names for each application (a stream's checkpoint) the last batch that the table holds. A
merge finds the buckets of its rows, reads and rewrites these alone, and commits the next manifest by a rename that
fails if another writer took the number; then the merge is put on top of that writer's version, and done again only
if both touched the same bucket. A batch that the ledger holds is skipped, so a repeated one changes nothing, and a new
checkpoint or a second stream goes on from the newest version.

The last KEEP versions stay for readers; folders that only older ones name are removed. A failed write leaves folders
that no manifest names, which nobody reads.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.scratch import listed, read_text, removed, write_new

BUCKET = "_bucket"


class Conflict(Exception):
    """Another writer kept committing first."""


def nullable(schema: T.StructType) -> T.StructType:
    """A schema whose fields, elements and values may be null at every depth, as those of files are."""
    return T.StructType.fromJson(json.loads(re.sub(r'("(?:nullable|containsNull|valueContainsNull)": ?)false', r"\1true", json.dumps(schema.jsonValue()))))


class VersionedTable:
    """A table under a root. Schema, keys and number of buckets are those of its first version; later ones read them there.

    Choose so many buckets that one, the least that a merge rewrites, fits a task. Without keys all rows are one bucket.
    """

    KEEP, TRIES = 2, 20

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str | None = None, keys: list[str] = (), buckets: int = 32):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), list(keys), buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    # Versions

    def versions(self) -> list[int]:
        """Numbers of the versions that are kept, in order."""
        return sorted(int(m[1]) for n in listed(self.spark, f"{self.root}/_versions") if (m := re.fullmatch(r"([0-9]{12})\.json", n)))

    def manifest(self, version: int | None = None) -> dict | None:
        """What a version, the newest unless a number is given, consists of; None if the table has none."""
        for last in range(self.TRIES, 0, -1):
            number = max(self.versions(), default=None) if version is None else version
            if number is None:
                return None
            try:
                return {**json.loads(read_text(self.spark, self._file(number))), "version": number}
            except Py4JJavaError:  # other writers came so far meanwhile that this version was removed
                if version is not None or last == 1:
                    raise
        return None

    def ledger(self) -> dict[str, int]:
        """The last batch of each application."""
        return (self.manifest() or {}).get("ledger", {})

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest unless a number is given."""
        return self._rows(self.manifest(version))

    # Changes

    def write(self, df: DataFrame, app: str | None = None, batch: int | None = None) -> int:
        """A version of just these rows."""
        def build(base: dict, parts: dict) -> dict:
            return parts

        return self._change(df, build, app, batch, whole=True)

    def append(self, df: DataFrame, app: str | None = None, batch: int | None = None) -> int:
        """A version with these rows added, whatever their keys."""
        def build(base: dict, parts: dict) -> dict:
            return {b: [*base.get(b, []), *parts.get(b, [])] for b in {*base, *parts}}

        return self._change(df, build, app, batch)

    def merge(self, df: DataFrame, after: Callable[[DataFrame, DataFrame], DataFrame], app: str | None = None, batch: int | None = None) -> int:
        """A version in which after(rows of the table, df) replaces the rows of the buckets that the keys of df fall into.

        after must decide each key by the rows of that key alone, as upserts, deletes and change feeds do.
        """
        if not self._keys():
            raise ValueError(f"{self.root} has no keys to merge by")
        return self._change(df, after, app, batch, merged=True)

    # Inside

    def _file(self, number: int) -> str:
        return f"{self.root}/_versions/{number:012d}.json"

    def _keys(self) -> list[str]:
        found = self.manifest()
        return found["keys"] if found else self.keys

    def _rows(self, manifest: dict | None, buckets: set[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"]) if manifest else self.schema
        if schema is None:
            raise ValueError(f"{self.root} holds no version yet, and no schema is given")
        parts = manifest["parts"] if manifest else {}
        paths = [f"{self.root}/{p}" for b, found in sorted(parts.items()) if buckets is None or b in buckets for p in found]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, schema: T.StructType, keys: list[str], buckets: int) -> Column:
        # In the table's own types: equal numbers of other types hash otherwise.
        return F.pmod(F.hash(*[F.col(f"`{k}`").cast(schema[k].dataType) for k in keys]), F.lit(buckets)) if keys else F.lit(0)

    def _stored(self, df: DataFrame, bucket: Column, buckets: int) -> dict[str, list[str]]:
        """Write rows by bucket, one file each, and return the folders."""
        path = f"data/{uuid.uuid4().hex}"
        df.withColumn(BUCKET, bucket).repartition(buckets, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{path}")
        names = [n for n in listed(self.spark, f"{self.root}/{path}") if n.startswith(f"{BUCKET}=")]
        return {n.partition("=")[2]: [f"{path}/{n}"] for n in names}

    def _change(self, df: DataFrame, build: Callable, app: str | None, batch: int | None, whole: bool = False, merged: bool = False) -> int:
        base = self.manifest()
        if self._known(base, app, batch):
            return base["version"]
        schema = T.StructType.fromJson(base["schema"]) if base and not whole else self.schema or df.schema
        schema = nullable(schema)
        keys, buckets = (base["keys"], base["buckets"]) if base else (self.keys, self.buckets if self.keys else 1)
        bucket = self._bucket(schema, keys, buckets)
        # The new rows are evaluated once, whatever happens afterwards.
        new = self._stored(df if merged else df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields]), bucket, buckets)
        made: dict[str, list[str]] | None = None
        seen: dict | None = None
        for _ in range(self.TRIES):
            old = base["parts"] if base else {}
            if merged:
                touched = {b: old.get(b, []) for b in new}
                if made is None or touched != seen:
                    given = self.spark.read.schema(df.schema).parquet(*[f"{self.root}/{p}" for found in new.values() for p in found]) if new else df.limit(0)
                    rows = build(self._rows(base or {"schema": json.loads(schema.json()), "parts": {}}, set(new)), given)
                    rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields])
                    try:
                        made, seen = (self._stored(rows, bucket, min(buckets, len(new))) if new else {}), touched
                    except Exception:
                        if base is None or base["version"] in self.versions():
                            raise
                        base = self.manifest()  # its files were removed while they were read: others came far ahead
                        if self._known(base, app, batch):
                            return base["version"]
                        continue
                parts = {b: p for b, p in old.items() if b not in new} | made
            else:
                parts = build(old, new)
            ledger = (base or {}).get("ledger", {}) | ({app: batch} if app is not None else {})
            number = base["version"] + 1 if base else 0
            text = json.dumps({"schema": json.loads(schema.json()), "keys": keys, "buckets": buckets, "parts": parts, "ledger": ledger})
            if write_new(self.spark, self._file(number), text):
                if merged:  # the folder above the buckets' own ones
                    for path in {p.rpartition("/")[0] for found in new.values() for p in found}:
                        removed(self.spark, f"{self.root}/{path}")
                self._forget()
                return number
            base = self.manifest()
            if self._known(base, app, batch):
                return base["version"]
        raise Conflict(f"{self.root}: {self.TRIES} versions of other writers came first")

    @staticmethod
    def _known(base: dict | None, app: str | None, batch: int | None) -> bool:
        return bool(base) and app is not None and base["ledger"].get(app, -1) >= batch

    def _forget(self) -> None:
        """Remove versions beyond the last KEEP, and the folders that only they name."""
        numbers = self.versions()
        try:
            self._removed(numbers)
        except Py4JJavaError:
            pass  # another writer removes the same; what it leaves, the next one finds

    def _removed(self, numbers: list[int]) -> None:
        folders = lambda n: {p for found in self.manifest(n)["parts"].values() for p in found}
        old, kept = numbers[: -self.KEEP], set().union(*[folders(n) for n in numbers[-self.KEEP :]])
        for number in old:
            for path in folders(number) - kept:
                removed(self.spark, f"{self.root}/{path}")
            removed(self.spark, self._file(number))
