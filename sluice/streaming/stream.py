"""The chain on streams: micro-batches, merges that can be repeated, and change detection with kept state."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sluice.functions.scratch import listed, read_text, removed, shared_path, write_new
from sluice.operators import changes, merge
from sluice.operators.rows import spread
from sluice.plans.pipeline import Pipeline
from sluice.sources import sinks
from sluice.sources.versioned import VersionedTable


def available(spark: SparkSession, path: str, schema, files_per_batch: int | None = None, format: str = "parquet") -> DataFrame:
    """A stream of the files of a folder; files_per_batch bounds each micro-batch."""
    reader = spark.readStream.format(format).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run an action on each micro-batch until all that is available is done."""
    return stream.writeStream.outputMode(mode).foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def application(spark: SparkSession, checkpoint: str) -> str:
    """The identity of a stream: the one that Spark keeps in its checkpoint, so a new checkpoint is another stream."""
    return json.loads(read_text(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]


def run_chain(stream: DataFrame, pipeline: Pipeline, target: str | None, letters: str, checkpoint: str) -> StreamingQuery:
    """The batch chain on every micro-batch: dead letters of every step, failure policy, then destinations.

    Rows go to target, one folder for each stream and batch, and to the specification's destinations. A repeated batch
    replaces its folders; versioned tables and databases loaded through their driver skip a batch that their ledger holds; files by
    append can get a batch again if the run ended between its write and the checkpoint. What a destination refuses
    goes to the dead letters that the specification names. A breach of the policy stops
    the stream after the batch's dead letters are written. Progress rows go where the specification says.
    """
    spark, spec = stream.sparkSession, pipeline.spec

    def action(batch: DataFrame, number: int) -> None:
        app = application(spark, checkpoint)
        # A batch of one small file is a single task, however much its steps cost a row.
        result, rejected = pipeline.applied(spread(batch) if pipeline.costly else batch)
        if target:
            sinks.replace(result.good, f"{target}/app={app}/batch={number}")
        sinks.replace(rejected, f"{letters}/app={app}/batch={number}")
        pipeline.enforce(result, rejected)
        pipeline.load(result, app, number)
        if "progress" in spec:
            sinks.replace(result.progress(number), f"{spec['progress']}/app={app}/batch={number}")
        result.discard()

    return each_batch(stream, action, checkpoint)


def progress(query: StreamingQuery) -> DataFrame:
    """A row for each batch that had input: its number, rows, milliseconds and rows a second."""
    spark = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active()
    found = {p["batchId"]: p for p in map(dict, query.recentProgress) if p["numInputRows"]}
    rows = [(n, p["numInputRows"], p["durationMs"].get("triggerExecution"), p["processedRowsPerSecond"]) for n, p in sorted(found.items())]
    return spark.createDataFrame(rows, "batch long, input_rows long, duration_ms long, rows_per_second double")


def merge_stream(stream: DataFrame, table: VersionedTable, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Upsert each micro-batch by key; of equal keys, in the batch or the table, the last by order wins.

    The table's ledger holds the last batch of each stream: one that comes again is skipped, after a crash too, and several
    streams or a new checkpoint go on from the table as it is.
    """
    table.keys = table.keys or list(keys)

    def action(batch: DataFrame, number: int) -> None:
        newest = lambda before, rows: merge.upsert(before, before.unionByName(rows), keys, order)
        table.merge(batch, newest, application(table.spark, checkpoint), number)

    return each_batch(stream, action, checkpoint)


#: The kept state of change detection: key as JSON, row hash, and the last snapshot that held it.
HASHES = "_name string, _old binary, _last long"


def detect_changes(
    stream: DataFrame, out: str, keys: list[str], checkpoint: str, order: list[str] = (), gone: str | None = None, snapshot: str | None = None, ends: str | None = None, buckets: int = 64
) -> StreamingQuery:
    """Emit rows that are new or changed against the kept hashes, and keys that are gone; unchanged repeats give nothing.

    The hashes are a versioned table in the checkpoint: a batch is joined with it, and the buckets of the keys that it changes are
    rewritten. A batch's changes are written before its hashes are committed, and its number stands in the table's ledger, so one that
    comes again gives the same. INSERT, UPDATE or DELETE is in _cdc_op; a DELETE has the keys and nulls. Of the rows of a key
    in one batch the last by order counts; without an order, by their JSON.

    Keys are deleted in two ways. Rows for which the SQL condition gone holds say so of their key. Or the stream brings
    whole snapshots: the column snapshot numbers them one after another, and a row for which the condition ends holds says
    that all rows of its snapshot have come, as does a row of a later snapshot for those before; then the keys that it lacks are
    deleted. Rows of a snapshot that come in a batch after its end are late and are ignored.
    """
    spark, kinds = stream.sparkSession, stream.schema
    rest = [c for c in stream.columns if c not in keys and c != snapshot]
    told = lambda text: F.coalesce(F.expr(text), F.lit(False)) if text else F.lit(False)
    as_json = lambda names: F.to_json(F.struct(*[f"`{c}`" for c in names]), {"ignoreNullFields": "false"})
    kept = VersionedTable(spark, f"{checkpoint.rstrip('/')}/hashes", HASHES, ["_name"], buckets)
    marks = f"{checkpoint.rstrip('/')}/ended"
    number_of = F.coalesce(F.col(snapshot).cast("long"), F.raise_error(F.lit("a row has no snapshot number")).cast("long")) if snapshot else F.lit(0).cast("long")

    def ended_before(number: int) -> int | None:
        """The last snapshot that had ended before a batch; files named batch=snapshot tell."""
        found = [tuple(map(int, n.split("="))) for n in listed(spark, marks) if re.fullmatch(r"[0-9]+=-?[0-9]+", n)]
        return max(((n, s) for n, s in found if n < number), default=(None, None))[1]

    def action(batch: DataFrame, number: int) -> None:
        app, paths = application(spark, checkpoint), []
        if kept.ledger().get(app, -1) >= number:
            return
        plain = batch.drop(snapshot) if snapshot else batch
        rows = batch.select(
            as_json(keys).alias("_name"),
            as_json(rest).alias("_body"),
            F.when(~told(gone), F.unhex(changes.row_hash(plain, keys))).alias("_hash"),
            number_of.alias("_snap"),
            told(ends).alias("_mark"),
            *[F.col(f"`{c}`").alias(f"_by{k}") for k, c in enumerate(order)],
        )
        before = ended = ended_before(number) if snapshot else None
        if snapshot:
            last = rows.agg(F.max(F.col("_snap") - 1 + F.col("_mark").cast("int"))).first()[0]
            ended = max((e for e in (before, last) if e is not None), default=None)
            rows = rows.where(F.col("_snap") > before) if before is not None else rows
        place = F.struct("_snap", *[f"_by{k}" for k in range(len(order))], "_body")
        newest = rows.where("not _mark").groupBy("_name").agg(F.max_by(F.struct("_body", "_hash", "_snap"), place).alias("_row"))
        came = spark.read.parquet(_written(newest.select("_name", "_row.*", F.lit(True).alias("_came")), paths))
        # Only where a snapshot has ended can keys go that did not come.
        both = came.join(kept.read(), "_name", "full" if ended != before else "left")
        now, at = F.when(F.col("_came"), F.col("_hash")).otherwise(F.col("_old")), F.coalesce("_snap", "_last")
        both = both.withColumn("_now", F.when((at >= ended) if ended is not None else F.lit(True), now))
        op = F.when(F.col("_now").isNull(), F.when(F.col("_old").isNotNull(), "DELETE")).when(F.col("_old").isNull(), "INSERT").when(F.col("_old") != F.col("_now"), "UPDATE")
        both = both.select("_name", "_body", "_now", at.alias("_at"), op.alias(merge.OP), "_came")
        both = both.where(F.col(merge.OP).isNotNull() | (F.col("_came") & F.col("_now").isNotNull() & F.lit(bool(snapshot))))
        found = spark.read.parquet(_written(both, paths))
        of = lambda column, names: F.from_json(column, T.StructType([kinds[n] for n in names]))
        back = found.where(F.col(merge.OP).isNotNull()).select(of("_name", keys).alias("k"), of("_body", rest).alias("b"), merge.OP)
        values = [F.when(F.col(merge.OP) != "DELETE", F.col(f"b.`{c}`")).alias(c) for c in rest]
        named = F.concat_ws(":", *[F.col(f"k.`{k}`").cast("string") for k in keys]).alias(merge.KEY)
        sinks.replace(back.select("k.*", *values, merge.OP, named), f"{out}/app={app}/batch={number}")
        if ended != before:
            write_new(spark, f"{marks}/{number}={ended}", "")
        after = lambda old, given: merge.without(old, given, ["_name"]).unionByName(given.where("_old is not null"))
        kept.merge(found.select("_name", F.col("_now").alias("_old"), F.col("_at").alias("_last")), after, app, number)
        for path in paths:
            removed(spark, path)

    return each_batch(stream, action, checkpoint)


def _written(df: DataFrame, paths: list[str]) -> str:
    """The folder, added to paths, into which a frame is written once."""
    paths.append(shared_path(df.sparkSession))
    df.write.parquet(paths[-1])
    return paths[-1]
