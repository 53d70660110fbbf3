"""Versioned tables, staged replaces, rolling files, loads that isolate rows, watermarks, replays and streams that lose nothing."""

import json
import sqlite3
import threading

import pytest
from pyspark.sql import functions as F

from sluice.functions.scratch import exists, write_new
from sluice.operators import merge, profiling, rows, scripts
from sluice.plans.pipeline import Pipeline
from sluice.sources import database, jdbc, messages, registry, rollwriter, sinks, zipcsv
from sluice.sources.plugin_stream import FileMessagesReader
from sluice.sources.versioned import Conflict, VersionedTable
from sluice.streaming import stream

KIND = "k long, v string"


def put(table, rows, **named):
    df = table.spark.createDataFrame(rows, KIND)
    return table.merge(df, lambda before, new: merge.upsert(before, new, ["k"]), **named)


def content(table, **named):
    return {r.k: r.v for r in table.read(**named).collect()}


def test_merges_rewrite_touched_buckets_only(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), KIND, ["k"], buckets=16)
    put(table, [(k, "a") for k in range(500)])
    before = table.manifest()["parts"]
    assert len(before) == 16
    put(table, [(7, "b"), (None, "null key")])
    after = table.manifest()["parts"]
    changed = [b for b in after if after[b] != before.get(b)]
    assert 1 <= len(changed) <= 2 and content(table) == {k: "b" if k == 7 else "a" for k in range(500)} | {None: "null key"}
    assert content(table, version=0)[7] == "a"
    # A key of a narrower type falls into the same bucket.
    table.merge(spark.createDataFrame([(8,)], "k int"), lambda old, new: merge.delete(old, new, ["k"]))
    assert 8 not in content(table) and len(content(table)) == 500
    # Emptied buckets vanish; what only forgotten versions hold is removed.
    table.merge(table.read().select("k"), lambda old, new: merge.delete(old, new, ["k"]))
    assert table.read().isEmpty() and table.manifest()["parts"] == {}
    put(table, [(1, "x")])
    named = {p for v in table.versions() for found in table.manifest(v)["parts"].values() for p in found}
    assert {f"data/{p.parent.name}/{p.name}" for p in (tmp_path / "t" / "data").glob("*/_bucket=*")} == named
    table.append(spark.createDataFrame([(1, "y")], KIND))
    assert sorted(r.v for r in table.read().collect()) == ["x", "y"]


def test_ledger_skips_repeated_batches(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), KIND, ["k"], 4)
    put(table, [(1, "a")], app="s", batch=0)
    put(table, [(1, "b")], app="s", batch=0)
    assert content(table) == {1: "a"} and table.versions() == [0]
    put(table, [(2, "c")], app="other", batch=0)
    put(table, [(1, "d")], app="s", batch=1)
    assert content(table) == {1: "d", 2: "c"} and table.ledger() == {"s": 1, "other": 0}


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    put(VersionedTable(spark, root, KIND, ["k"], 4), [(0, "a")])
    failed = []

    def write(n):
        try:
            for j in range(2):
                put(VersionedTable(spark, root), [(10 * n + j, f"{n}"), (0, f"{n}")])
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in (1, 2, 3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and set(content(VersionedTable(spark, root))) == {0, 10, 11, 20, 21, 30, 31}
    table = VersionedTable(spark, root)
    monkeypatch.setattr("sluice.sources.versioned.write_new", lambda *a: False)
    monkeypatch.setattr(VersionedTable, "TRIES", 2)
    with pytest.raises(Conflict):
        put(table, [(5, "z")])


def test_only_one_file_of_a_name(spark, tmp_path):
    path = str(tmp_path / "d" / "x.json")
    assert write_new(spark, path, "one") and not write_new(spark, path, "two")
    assert (tmp_path / "d" / "x.json").read_text() == "one" and [p.name for p in (tmp_path / "d").glob("*.tmp")] == []


def test_failed_replace_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "x")
    sinks.replace(spark.range(5), path)
    with pytest.raises(Exception, match="(?i)zero"):
        sinks.replace(spark.range(9).selectExpr("if(id = 8, id div (id - 8), id) as id"), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["x"]
    sinks.replace(spark.read.parquet(path).where("id < 3"), path)  # from the folder itself
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2]
    (tmp_path / "x").rename(tmp_path / "_old-x")  # cut short between the two moves
    sinks.recover(spark, path)
    assert spark.read.parquet(path).count() == 3
    sinks.replace(spark.range(1), path)
    assert spark.read.parquet(path).count() == 1 and [p.name for p in tmp_path.iterdir()] == ["x"]


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_files_roll_by_running_bytes(spark, tmp_path, format):
    path = str(tmp_path / "r")
    df = spark.range(3000).selectExpr("id", "repeat('x', if(id % 100 = 0, 3000, 10)) as v").repartition(3, "id")
    made = sinks.rolling(df, path, format, max_rows=700, max_bytes=20_000)
    names = sorted(p.name for p in (tmp_path / "r").glob("part_*"))
    assert names == [f"part_{k:05d}.{format}" for k in range(1, made + 1)] and made >= 6
    read = spark.read.parquet(path) if format == "parquet" else spark.read.option("header", True).csv(path)
    sizes = read.groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.sum(F.length("v") + 12).alias("b")).collect()
    assert sum(r.n for r in sizes) == 3000 and max(r.n for r in sizes) <= 700 and max(r.b for r in sizes) <= 20_000
    assert sinks.rolling(spark.range(2).selectExpr("id", "'y' as v"), path, format) >= 1
    assert sinks.rolling(df.limit(0), path, format) == 0
    assert not list((tmp_path / "r" / "_rolling").glob("*/*.parquet"))


def test_rolling_survives_failures(spark, tmp_path):
    path = str(tmp_path / "r")
    with pytest.raises(Exception, match="(?i)zero"):
        sinks.rolling(spark.range(2000).selectExpr("if(id = 1999, id div (id - 1999), id) as id").repartition(2), path, max_rows=100)
    assert not list((tmp_path / "r").glob("part_*"))
    # A commit whose moves were cut short: the manifest is there, some files are in place.
    format = registry.resolve(spark, "rolling")
    spark.range(10).repartition(3).write.format(format).options(path=path, max_rows="2").mode("append").save()
    assert not list((tmp_path / "r").glob("part_*"))
    (manifest,) = (tmp_path / "r" / "_rolling" / "manifests").glob("*.json")
    source, target, _ = json.loads(manifest.read_text())[0]
    (tmp_path / "r" / source).rename(tmp_path / "r" / target)
    assert rollwriter.finish(spark, path).agg(F.sum("rows")).first()[0] == 10
    assert spark.read.parquet(path).count() == 10 and rollwriter.finish(spark, path).isEmpty()


def test_messages_go_in_groups(spark, tmp_path):
    folder = str(tmp_path / "sent")
    told = {"format": "groups", "key": "id", "options": {"sender": "sluice.sources.rollwriter:FolderSender", "folder": folder, "size": "10"}}
    sinks.load(spark.range(95).repartition(3), {"name": "broker", "publish": told})
    groups = [json.loads(line) for p in (tmp_path / "sent").iterdir() for line in p.read_text().splitlines()]
    assert all(len(g) <= 10 for g in groups) and sum(len(g) == 10 for g in groups) >= 7
    assert sorted(int(m["key"]) for g in groups for m in g) == [*range(95)] and all(json.loads(m["value"])["id"] == int(m["key"]) for g in groups for m in g)


@pytest.fixture
def people(tmp_path):
    path = str(tmp_path / "db.sqlite")
    link = sqlite3.connect(path)
    link.execute("CREATE TABLE people (id INTEGER PRIMARY KEY, age INTEGER CHECK (age >= 0), name TEXT NOT NULL)")
    link.execute("INSERT INTO people VALUES (50, 1, 'there already')")
    link.commit()
    link.close()
    return path


def rows_of(path):
    link = sqlite3.connect(path)
    try:
        return link.execute("SELECT id, age, name FROM people ORDER BY id").fetchall()
    finally:
        link.close()


def test_refused_rows_are_isolated(spark, people):
    df = spark.range(200).selectExpr("id", "if(id % 31 = 5, -1, id) as age", "if(id = 77, null, concat('p', id)) as name").repartition(3, "id")
    options = {"path": people}
    refused = database.load(df, "tests.database:connect", options, "people", batch=40, run="first")
    bad = {k for k in range(200) if k % 31 == 5} | {50, 77}
    assert {json.loads(r.row_payload)["id"] for r in refused.collect()} == bad
    assert {i for i, *_ in rows_of(people)} == set(range(200)) - bad | {50}
    assert "CHECK" in next(r.error for r in refused.collect() if json.loads(r.row_payload)["id"] == 5)
    # The same run again loads nothing twice, and tells the same.
    again = database.load(df, "tests.database:connect", options, "people", batch=40, run="first")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, refused.collect())) and len(rows_of(people)) == 200 - len(bad) + 1


def test_halving_finds_the_rows():
    taken = []

    def insert(rows):
        if any(r in (3, 700) for r in rows):
            raise ValueError("no")
        taken.extend(rows)

    assert [r for r, _ in database.halved([*range(1000)], insert)] == [3, 700]
    assert sorted(taken) == [k for k in range(1000) if k not in (3, 700)] and list(database.halved([], insert)) == []


def test_load_failures_become_letters_of_the_chain(spark, tmp_path, people):
    source = str(tmp_path / "in")
    spark.range(20).selectExpr("id", "id - 2 as age", "concat('p', id) as name").write.parquet(source)
    spec = {"sources": [{"type": "parquet", "path": source}], "dead_letters": str(tmp_path / "dead"), "destinations": [{"name": "db", "connect": "tests.database:connect", "options": {"path": people}, "table": "people"}]}
    result = Pipeline(spec).run(spark)
    assert result.counts["refused"] == 2 and len(rows_of(people)) == 19
    dead = spark.read.parquet(spec["dead_letters"]).collect()
    assert len(dead) == 2 and all(r.error_trace.startswith("LoadError: IntegrityError") for r in dead)


def test_watermarks_move_after_the_load(spark, tmp_path):
    a, b, out = (str(tmp_path / n) for n in "abo")
    first = spark.sql("select id, timestamp'2024-01-01' + make_interval(0,0,0,int(id)) as at, if(id = 3, null, 'x') as v from range(5)")
    first.write.parquet(a)
    first.selectExpr("id + 100 as id", "id as seq", "v").write.parquet(b)
    spec = {
        "job_id": "j",
        "sources": [{"name": "a", "type": "parquet", "path": a, "delta": {"watermark_column": "at"}}, {"name": "b", "type": "parquet", "path": b, "delta": {"watermark_column": "seq", "initial_watermark": 1}}],
        "contract": {"not_null": ["v"]},
        "watermarks": str(tmp_path / "marks"),
        "progress": str(tmp_path / "progress"),
        "destinations": [{"name": "o", "path": out}],
    }
    Pipeline(spec).run(spark)
    ids = lambda: sorted(r.id for r in spark.read.parquet(out).select("id").collect())
    assert ids() == [0, 1, 2, 4, 102, 104]
    assert Pipeline(spec).committed(spark) == {"a": "2024-01-05 00:00:00", "b": "4"}
    Pipeline(spec).run(spark)
    assert ids() == [0, 1, 2, 4, 102, 104]
    spark.sql("select 9L as id, timestamp'2024-02-01' as at, 'x' as v").write.mode("append").parquet(a)
    with pytest.raises(ValueError, match="match_keys"):  # fails while loading: the watermark stays
        Pipeline(spec | {"destinations": [{"name": "o", "path": out, "mode": "upsert"}]}).run(spark)
    assert Pipeline(spec).committed(spark)["a"] == "2024-01-05 00:00:00"
    Pipeline(spec).run(spark)
    assert ids() == [0, 1, 2, 4, 9, 102, 104] and Pipeline(spec).committed(spark) == {"a": "2024-02-01 00:00:00", "b": "4"}
    told = spark.read.parquet(spec["progress"]).collect()
    assert sorted(r.rows_written for r in told) == [0, 1, 1, 6] and [bool(r.error) for r in told].count(True) == 1


def test_replay_merges_and_marks(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    spark.createDataFrame([(1, "7"), (2, "x"), (3, "y")], "id long, n string").write.parquet(source)
    spec = {"job_id": "j", "sources": [{"type": "parquet", "path": source}], "dead_letters": str(tmp_path / "dead"), "steps": [{"type": "cast", "column": "n", "target_type": "int"}], "destinations": [{"name": "t", "path": target, "mode": "upsert", "match_keys": ["id"]}]}
    Pipeline(spec).run(spark)
    mended = Pipeline(spec | {"steps": [{"type": "expression", "target_column": "n", "expression": "if(n = 'x', '8', n)"}, *spec["steps"]]})
    assert len(mended.pending(spark)) == 1
    result = mended.replay(spark, "id long, n string")
    assert result.counts["written"] == 1 and result.counts["failed"] == 1
    assert {r.id: r.n for r in VersionedTable(spark, target).read().collect()} == {1: 7, 2: 8}
    assert len(mended.pending(spark)) == 1  # what failed again
    mended.replay(spark, "id long, n string")
    assert {r.id: r.n for r in VersionedTable(spark, target).read().collect()} == {1: 7, 2: 8}
    assert spark.read.parquet(spec["dead_letters"]).count() == 4


def test_sources_of_a_specification(spark, tmp_path):
    (tmp_path / "bodies").mkdir()
    (tmp_path / "bodies" / "one.json").write_text('{"items": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "d.json").write_text('{"id": 3, "keep": true}\n{"id": 4, "keep": false}')
    url = "jdbc:derby:memory:chain;create=true"
    sinks.load(spark.sql("select id + 10 as ID from range(3)"), {"name": "db", "url": url, "table": "NUMBERS"})
    put(VersionedTable(spark, str(tmp_path / "v"), KIND, ["k"]), [(20, "a")])
    (tmp_path / "told").mkdir()
    (tmp_path / "told" / "m.txt").write_text('{"payload": {"id": 30}}\n{"payload": {"id": 31}}\n')
    sources = [
        {"type": "json_bodies", "path": str(tmp_path / "bodies"), "schema": "id long", "data_key": "items"},
        {"type": "documents", "path": str(tmp_path / "docs"), "schema": "id long, keep boolean", "query": "keep", "projection": ["id"]},
        {"type": "database", "url": url, "query": "SELECT ID AS \"id\" FROM NUMBERS WHERE ID > 10"},
        {"type": "database", "url": url, "table": "NUMBERS", "shard_column": "ID", "first": 10, "last": 12, "shards": 2},
        {"type": "versioned", "path": str(tmp_path / "v")},
        {"type": "messages", "format": "json", "schema": "id long", "payload": "payload", "options": {"path": str(tmp_path / "told")}, "value": "line"},
    ]
    got = [sorted(r[0] for r in Pipeline({"sources": [s]}).source(spark).collect()) for s in sources[:-1]]
    assert got == [[1, 2], [3], [11, 12], [10, 11, 12], [20]]
    with pytest.raises(ValueError, match="unknown source type"):
        Pipeline({"sources": [{"type": "carrier pigeon"}]})


def test_destinations_of_a_specification(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1, "Ann"), (2, "Bo")], "id long, name string").write.parquet(a)
    spark.createDataFrame([(1, 10, 5.0), (1, 11, 2.0), (3, 12, 1.0)], "id long, item long, price double").write.parquet(b)
    told = {"parent": "a", "child": "b", "key": "id", "target": "items", "order": ["item"], "parent_columns": ["id", "name"], "child_columns": ["id", "item", "price"]}
    spec = {
        "sources": [{"name": "a", "type": "parquet", "path": a}, {"name": "b", "type": "parquet", "path": b}],
        "destinations": [
            {"name": "documents", "path": str(tmp_path / "docs"), "mode": "upsert", "match_keys": ["id"], "nested": told},
            {"name": "text", "path": str(tmp_path / "text"), "format": "csv", "options": {"sep": ";"}, "condition": "_source == 'a'"},
            {"name": "rolled", "path": str(tmp_path / "rolled"), "rolling": {"max_rows": 2}},
        ],
    }
    Pipeline(spec).run(spark)
    found = {r.id: [i.item for i in r["items"]] for r in VersionedTable(spark, str(tmp_path / "docs")).read().collect()}
    assert found == {1: [10, 11], 2: []}
    assert "id;name" in next((tmp_path / "text").glob("*.csv")).read_text() and len(list((tmp_path / "rolled").glob("part_*"))) >= 3


def test_scripts_from_files_and_modules(spark, tmp_path):
    path = tmp_path / "step.py"
    path.write_text("def transform_df(df):\n    return df.assign(id=df.id * 2)\n")
    out = Pipeline({"steps": [{"type": "script", "path": str(path)}, {"type": "script", "module": "tests.scripted"}]}).apply(spark.range(3)).good
    assert sorted(r.id for r in out.collect()) == [1, 3, 5]


STUBBORN = """
def transform_records(rows):
    for r in rows:
        if r['id'] == 6:
            while True:
                try:
                    sum(range(10**9))
                except BaseException:
                    pass
        if r['id'] == 3:
            import os
            os._exit(1)
        if r['id'] == 2:
            raise ValueError('two')
    return rows
"""


def test_scripts_end_at_the_deadline_whatever_they_catch(spark):
    df = spark.range(8).repartition(1)
    good, dead = scripts.run_isolated(df, *scripts.compiled(STUBBORN), df.schema, timeout=1.0)
    assert sorted(r.id for r in good.collect()) == [0, 1, 4, 5, 7]
    errors = {json.loads(r.row_payload)["id"]: r.error for r in dead.collect()}
    assert "timed out" in errors[6] and "ended its process" in errors[3] and errors[2] == "ValueError: two"


def test_offset_log(tmp_path):
    for name in ("m1", "m2"):
        (tmp_path / name).write_text(name)
    reader = FileMessagesReader({"path": str(tmp_path), "files_per_batch": "1"})
    assert reader.initialOffset() == {"batch": 0}
    assert [reader.latestOffset() for _ in range(3)] == [{"batch": 1}, {"batch": 2}, {"batch": 2}]
    (tmp_path / "a0").write_text("late")
    assert reader.latestOffset() == {"batch": 3}
    files = lambda a, b: [p.rpartition("/")[2] for x in again.partitions({"batch": a}, {"batch": b}) for p in x.paths]
    again = FileMessagesReader({"path": str(tmp_path), "files_per_batch": "1"})
    assert again.latestOffset() == {"batch": 3} and files(2, 3) == ["a0"] and files(0, 3) == ["m1", "m2", "a0"]
    fresh = FileMessagesReader({"path": str(tmp_path), "files_per_batch": "1"})
    fresh.initialOffset()
    assert fresh.latestOffset() == {"batch": 1}  # a new checkpoint is still bounded


def test_deletes_by_condition(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("s", "o", "c"))
    kind = "k long, v string, dropped boolean"
    for rows in ([(1, "a", False), (2, "b", False)], [(1, None, True), (2, "b", False), (3, None, True)], [(1, "a", False)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        stream.detect_changes(stream.available(spark, source, spark.createDataFrame([], kind).schema), out, ["k"], checkpoint, gone="dropped").awaitTermination()
    got = sorted((r.batch, r.k, r.v, r[merge.OP]) for r in spark.read.parquet(out).collect())
    assert got == [(0, 1, "a", "INSERT"), (0, 2, "b", "INSERT"), (1, 1, None, "DELETE"), (2, 1, "a", "INSERT")]


def test_composite_keys(spark):
    df = spark.sql("select id div 10 as a, id % 10 as b, id % 7 as c, nullif(id, 3) as d, id % 2 as e from range(1000)")
    found = {tuple(r.columns) for r in profiling.composite_keys(df, ["a", "b", "c", "d", "e"]).collect()}
    assert found == {("a", "b"), ("a", "c", "e")}
    assert {tuple(r.columns) for r in profiling.composite_keys(spark.range(5), ["id"]).collect()} == {("id",)}
    assert {tuple(r.columns) for r in profiling.composite_keys(spark.range(0), ["id"]).collect()} == {("id",)}
    assert profiling.composite_keys(spark.sql("select 1 as a, 2 as b from range(2)"), ["a", "b"]).isEmpty()


def test_composite_keys_tasks_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(profiling, "ROWS", 10_000, raising=False)
    store = spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def most_read(since: int) -> tuple[int, int]:
        """Last stage, and the most rows that a task of a stage after one read from a shuffle."""
        stages, last, most = store.stageList(None, False, False, quantiles, None), since, 0
        for i in range(stages.size()):
            stage = stages.apply(i)
            if stage.stageId() > since:
                last, tasks = max(last, stage.stageId()), store.taskList(stage.stageId(), stage.attemptId(), 10_000)
                metrics = [tasks.apply(j).taskMetrics() for j in range(tasks.size())]
                most = max([most, *[m.get().shuffleReadMetrics().recordsRead() for m in metrics if m.isDefined()]])
        return last, most

    for rows in (50_000, 200_000):
        since, _ = most_read(-1)
        df = spark.range(rows).selectExpr("id div 100 as a", "id % 100 as b")
        assert {tuple(r.columns) for r in profiling.composite_keys(df, ["a", "b"]).collect()} == {("a", "b")}
        _, most = most_read(since)
        assert 9_000 < most < 12_000


def test_rows_are_dealt_by_their_number(spark):
    parts = [profiling.dealt(spark.range(9), n, "id").rdd.getNumPartitions() for n in (0, 1, 500_001, 90_000_000, 216_000_000, 1_000_000_000)]
    assert parts == [1, 1, 2, 180, 200, 500]


def test_inclusions_ignore_names(spark):
    tables = {"p": spark.range(3000).selectExpr("id as x", "string(id) as s"), "c": spark.range(500).selectExpr("id * 2 as y", "if(id = 7, null, string(id)) as t", "id - 1 as z"), "e": spark.sql("select cast(null as long) as n")}
    found = {(r.child_table, r.child_column, r.parent_table, r.parent_column): r.distinct_values for r in profiling.inclusions(tables).collect()}
    assert found == {("c", "y", "p", "x"): 500, ("c", "t", "p", "s"): 499}


def test_ranges_of_equal_depth(spark):
    df = spark.range(20_000).selectExpr("cast(pow(id, 3) as long) as k").unionByName(spark.sql("select cast(null as long) as k"))
    bounds = profiling.depth_bounds(df, "k", 8)
    conditions = profiling.range_predicates("k", bounds)
    sizes = [df.where(c).count() for c in conditions]
    assert len(sizes) == 8 and sum(sizes) == 20_001 and max(sizes) <= 1.2 * 2500
    assert profiling.range_predicates("k", []) == ["1 = 1"] and profiling.depth_bounds(df, "k", 1) == []
    ranges = profiling.depth_ranges(df, "k", 8).collect()
    assert ranges[0].first is None and ranges[-1].last is None and [r.last for r in ranges[:-1]] == [r.first for r in ranges[1:]]
    url = "jdbc:derby:memory:skew;create=true"
    jdbc.append(df.limit(3000).withColumnRenamed("k", "K"), url, "SKEWED")
    back = jdbc.read_balanced(spark, url, "SKEWED", "K", 4, 0, 10**9)
    sizes = [r["count"] for r in back.groupBy(F.spark_partition_id()).count().collect()]
    assert back.count() == 3000 and len(sizes) == 4 and max(sizes) <= 1.2 * 750


def test_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "if(id % 10 = 0, null, concat('v', id)) as v", "struct(id as a) as s").repartition(3).write.parquet(path)
    rows = profiling.footers(spark, path).collect()
    assert len({r.file for r in rows}) == 3 and {r.column for r in rows} == {"id", "v", "s.a"}
    assert sum(r.nulls for r in rows if r.column == "v") == 100 and min(int(r.least) for r in rows if r.column == "id") == 0
    told = profiling.footer_counts(spark, path).first()
    assert (told.rows, told.files) == (1000, 3) and told.bytes == sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    assert profiling.footer_counts(spark, str(tmp_path / "none")).first().rows == 0


def test_kafka_options_reach_a_stream(spark, tmp_path):
    """A stand-in takes the options of a Kafka source and gives its columns; the messages are parsed end to end."""
    out = str(tmp_path / "out")
    registry.register("stand-in", "tests.standin:StandIn")
    for action, want in (("replay_from_start", [0, 1, 2, 3]), ("process_new_only", [2, 3])):
        told = messages.kafka_options("host:9092", "topic", "group", action)
        lines = messages.stream(spark, registry.resolve(spark, "stand-in"), **told)
        parsed = messages.parse(lines, "id long, name string", payload="payload")
        run = parsed.writeStream.format("parquet").option("path", f"{out}/{action}").option("checkpointLocation", str(tmp_path / f"c-{action}")).trigger(processingTime="0 seconds").start()
        run.processAllAvailable()
        run.stop()
        assert sorted(r.id for r in spark.read.parquet(f"{out}/{action}").collect()) == want


def test_latest_of_rows_with_maps(spark):
    df = spark.sql("select id % 2 as k, map('a', id) as m from range(6)")
    assert {r.k: r.m for r in rows.latest_per_key(df, ["k"], "m").collect()} == {0: {"a": 4}, 1: {"a": 5}}


def test_archives_are_renamed_in_tasks(spark, tmp_path):
    path = str(tmp_path / "zips")
    zipcsv.write(spark.range(30).selectExpr("id", "concat('n', id) as name").repartition(3), path)
    assert len(list((tmp_path / "zips").glob("*.zip"))) == 3 and not list((tmp_path / "zips").glob("*.tmp"))
    assert zipcsv.read(spark, path, "id long, name string").count() == 30


def test_stored_tables_can_be_discarded(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    result = Pipeline({"sources": [{"type": "parquet", "path": source}], "destinations": [{"name": "o", "path": str(tmp_path / "o")}]}).run(spark)
    paths = list(result.stored)
    assert len(paths) >= 3 and all(exists(spark, p) for p in paths) and result.counts["written"] == 3
    result.discard()
    assert not any(exists(spark, p) for p in paths) and spark.read.parquet(str(tmp_path / "o")).count() == 3
