"""Queries on tables with odd rows or large keys, against their DuckDB SQL."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sluice.operators import protect
from sluice.plans.pipeline import Pipeline
from sluice.plans.queries import QUERIES, SQL
from sluice.streaming import stream

from .compare import same


@pytest.fixture
def replaced(tmp_path, sf_dir):
    """A folder of the smallest tables in which some are replaced."""

    def build(**tables) -> str:
        for source in Path(sf_dir).glob("*.parquet"):
            target = tmp_path / source.name
            if source.stem in tables:
                tables[source.stem].write.parquet(str(target))
            else:
                target.symlink_to(source)
        return str(tmp_path)

    return build


def test_last_watermark_of_zeros_and_errors(spark, sf_dir, replaced):
    rows = [(1, 1, 5.0, "click"), (1, 2, 0.0, "view"), (2, 3, 0.0, "click"), (3, 4, 1.0, "error"), (4, 5, None, "view"), (5, 6, 2.0, "view"), (5, None, 3.0, "view"), (6, 7, 4.0, None)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, value double, event_type string")
    events = events.selectExpr("event_id", "timestamp_ntz'2031-04-01 00:00:00' as ts", "user_id", "event_type", "value", "'{}' as props")
    same(QUERIES["last_watermark"](spark, found := replaced(events=events)), SQL["last_watermark"], found)


def test_equal_depth_shards_of_large_keys(spark, sf_dir, replaced):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_orderkey", F.col("l_orderkey") + 9_000_000)
    same(QUERIES["equal_depth_shards"](spark, found := replaced(lineitem=lines)), SQL["equal_depth_shards"], found)


def test_equal_depth_shards_without_rows(spark, sf_dir, replaced):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(0)
    same(QUERIES["equal_depth_shards"](spark, found := replaced(lineitem=lines)), SQL["equal_depth_shards"], found)


def test_changes_at_size_do_without_a_call_for_each_key(spark, tmp_path):
    """100,000 keys, of which a snapshot lacks some, others come late or twice; a batch that comes again gives the same."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("s", "o", "c"))
    kind, began = "k long, v string, snap int, last boolean", time.time()
    row = lambda where, snap, v="'a'": spark.range(100_000).where(where).selectExpr("id as k", f"{v} as v", f"{snap} as snap", "false as last")
    mark = lambda snap: spark.createDataFrame([(None, None, snap, True)], kind)
    late = row("id = 5", 1).unionByName(row("id = 7", 3)).unionByName(row("id = 7", 3, "'b'"))
    for df in (row("id >= 0", 1), mark(1), row("id % 2 = 0", 2, "if(id % 4 = 0, 'b', 'a')"), mark(2), late, row("id = 9", 5)):
        df.coalesce(1).write.mode("append").parquet(source)
        incoming = stream.available(spark, source, spark.createDataFrame([], kind).schema)
        stream.detect_changes(incoming, out, ["k"], checkpoint, snapshot="snap", ends="last").awaitTermination()
    got = spark.read.parquet(out).groupBy("batch", "_cdc_op", "v").count().collect()
    assert {(r.batch, r._cdc_op, r.v): r["count"] for r in got} == {
        (0, "INSERT", "a"): 100_000,
        (2, "UPDATE", "b"): 25_000,
        (3, "DELETE", None): 50_000,
        (4, "INSERT", "b"): 1,
        (5, "DELETE", None): 50_001,
        (5, "INSERT", "a"): 1,
    }
    assert time.time() - began < 150


def test_each_value_is_decrypted_once(spark):
    sealed = protect.encrypt_fields(spark.createDataFrame([(1, "Mirko", None), (2, "Ulf", "x")], "id long, name string, note string"), ["name", "note"], "k" * 32)
    for df in protect.decrypt_fields(sealed, ["name", "note"], "k" * 32):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("aesDecrypt") + plan.count("try_aes_decrypt") <= 2
    good, bad = protect.decrypt_fields(sealed, ["name", "note"], "k" * 32)
    assert sorted(map(tuple, good.collect())) == [(1, "Mirko", None), (2, "Ulf", "x")] and bad.isEmpty()
    assert protect.decrypt_fields(sealed, ["missing"], "k" * 32)[0].columns == sealed.columns


def test_ciphers_run_on_all_cores(spark, sf_dir):
    assert QUERIES["decrypt_fields"](spark, sf_dir).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_scripts_in_a_stream_run_on_all_cores(spark, tmp_path):
    source, out = str(tmp_path / "s"), str(tmp_path / "o")
    df = spark.range(4000).withColumn("task", F.lit(None).cast("int"))
    df.coalesce(1).write.parquet(source)
    code = "from pyspark import TaskContext\ndef transform_records(rows):\n    return [dict(r, task=TaskContext.get().partitionId()) for r in rows]\n"
    chain = Pipeline({"steps": [{"type": "script", "code": code, "schema": "id long, task int"}]})
    stream.run_chain(stream.available(spark, source, df.schema), chain, out, str(tmp_path / "l"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(out)
    assert got.select("id").distinct().count() == 4000 and got.select("task").distinct().count() == spark.sparkContext.defaultParallelism
