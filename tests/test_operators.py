"""Example rows for operators: contracts, changes, merges, scripts, protection, columns and planning."""

import pytest
from pyspark.sql import functions as F

from sluice.operators import changes, columns, contracts, enrich, merge, planning, protect, rows, scripts
from sluice.plans.pipeline import Pipeline
from sluice.sources import jdbc, messages, registry, sinks
from sluice.sources.versioned import VersionedTable


def test_contract_splits_rows_and_names_columns(spark):
    df = spark.createDataFrame([(1, "nora@inbox.example", 81.5, 31, "ACTIVE"), (2, "no at sign", -3.0, 44, "PENDING"), (3, None, 7.5, 131, "UNKNOWN"), (4, "pia@inbox.example", 9.9, 52, "ACTIVE")], "id long, email string, amount double, age long, status string")
    contract = {"not_null": ["id", "email", "absent"], "min_value": {"amount": 0}, "max_value": {"age": 100}, "allowed_values": {"status": ["ACTIVE", "PENDING"]}, "regex_match": {"email": r"[^@]+@[^@]+\.[^@]+$"}}
    good, bad = contracts.validate(df, contract)
    assert sorted(r.id for r in good.collect()) == [1, 4]
    errors = {r.id: r._errors for r in bad.collect()}
    assert [e.split(":")[0] for e in errors[2]] == ["amount", "email"]
    assert [e.split(":")[0] for e in errors[3]] == ["email", "age", "status"]
    letters = contracts.violation_letters(bad, "j", patterns=("email",)).collect()
    assert all(x.error_trace.startswith("DataQualityViolation: ") and protect.REDACTED in x.row_payload for x in letters)
    with pytest.raises(contracts.ContractViolation):
        contracts.require_valid(bad)
    contracts.require_valid(good.limit(0))


def test_policy_counts_shards_and_run(spark):
    df = spark.range(100).withColumn("bad", F.col("id") < 5)
    counts = contracts.failure_counts(df, F.floor(F.col("id") / 50), F.col("bad"))
    out = {r.shard: r.breached for r in contracts.evaluate_policy(counts, {"mode": "threshold", "chunk_percent": 10, "run_percent": 6}).collect()}
    assert out == {0: "chunk_percent", 1: "none", None: "none"}
    with pytest.raises(contracts.ContractViolation):
        contracts.enforce_policy(contracts.evaluate_policy(counts, {"mode": "stop_on_failure"}))
    contracts.enforce_policy(contracts.evaluate_policy(counts, {"mode": "continue"}))


def test_snapshot_diff(spark):
    kind = "id long, name string, balance double"
    one = spark.createDataFrame([(1, "Mirko", 12.5), (2, "Ulf", 80.0), (3, "Perdita", 7.25)], kind)
    two = spark.createDataFrame([(1, "Mirko", 12.5), (2, "Ulf", 81.0), (4, "Anouk", 3.0)], kind)
    first, state = changes.diff(changes.state_of(one.limit(0), ["id"]), one, ["id"])
    assert [r[merge.OP] for r in first.collect()] == ["INSERT"] * 3
    second, state = changes.diff(state, two, ["id"])
    assert {r.id: (r[merge.OP], r[merge.KEY]) for r in second.collect()} == {2: ("UPDATE", "2"), 4: ("INSERT", "4"), 3: ("DELETE", "3")}
    assert sorted(r.id for r in state.collect()) == [1, 2, 4]
    applied = merge.apply_changes(one, second, ["id"], [merge.SEQ])
    assert sorted(map(tuple, applied.collect())) == sorted(map(tuple, two.collect()))


def test_diff_with_null_keys_and_values(spark):
    one = spark.createDataFrame([(None, 1), (1, None)], "id long, v long")
    two = spark.createDataFrame([(None, 2), (1, None)], "id long, v long")
    found, _ = changes.diff(changes.state_of(one, ["id"]), two, ["id"])
    assert [(r.id, r.v, r[merge.OP]) for r in found.collect()] == [(None, 2, "UPDATE")]


def test_delta_in_two_runs(spark):
    kind = "id long, name string, updated_at string"
    source = spark.createDataFrame([(1, "Mirko", "2031-05-01T06:30:00"), (2, "Ulf", "2031-05-02T06:30:00"), (3, "Perdita", "2031-05-03T06:30:00")], kind)
    target, mark = changes.delta_sync(source, source.limit(0), ["id"], "updated_at", "2030-12-24T00:00:00")
    assert target.count() == 3 and mark.first()[0] == "2031-05-03T06:30:00"
    later = spark.createDataFrame([(1, "Mirko II", "2031-05-09T21:15:00"), (4, "Anouk", "2031-05-11T04:45:00")], kind)
    target, mark = changes.delta_sync(source.unionByName(later), target, ["id"], "updated_at", mark.first()[0])
    assert {r.id: r.name for r in target.collect()} == {1: "Mirko II", 2: "Ulf", 3: "Perdita", 4: "Anouk"}
    assert mark.first()[0] == "2031-05-11T04:45:00"
    numbers = source.withColumn("id", F.col("id") + 8)
    assert changes.after(numbers, "id", "9").count() == 2  # compared as numbers, not as text


def test_merge_twice_is_merge_once(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    source = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (None, "m")], "k long, v string")
    once = merge.upsert(target, source, ["k"], ["v"])
    twice = merge.upsert(once, source, ["k"], ["v"])
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert {r.k: r.v for r in once.collect()} == {1: "a", 2: "y", 3: "z", None: "m"}
    assert {r.k for r in merge.delete(target, source.select("k"), ["k"]).collect()} == {1}


def test_scripts_and_isolation(spark):
    df = spark.createDataFrame([(1, "Mirko"), (2, "rotten egg"), (3, "Perdita"), (4, "Anouk")], "id long, name string")
    code = "def transform_records(rows):\n    if any('rotten' in r['name'] for r in rows):\n        raise ValueError('bad')\n    return [dict(r, n=len(r['name'])) for r in rows]\n"
    fn, flavour = scripts.compiled(code)
    good, dead = scripts.run_isolated(df, fn, flavour, "id long, name string, n long")
    assert sorted((r.id, r.n) for r in good.collect()) == [(1, 5), (3, 7), (4, 5)]
    (letter,) = dead.collect()
    assert "rotten egg" in letter.row_payload and letter.error == "ValueError: bad"
    assert scripts.dry_run(df, "def transform(batch") ["valid"] is False
    assert scripts.dry_run(df.filter("id <> 2"), code)["flavour"] == "records"
    slow = "import time\ndef transform(batch):\n    time.sleep(0.3)\n    return batch\n"
    with pytest.raises(Exception, match="timed out"):
        scripts.run(df, *scripts.compiled(slow), df.schema, timeout=0.1).collect()
    endless = "def transform_records(rows):\n    while any('rotten' in r['name'] for r in rows):\n        pass\n    return rows\n"
    good, dead = scripts.run_isolated(df, *scripts.compiled(endless), df.schema, timeout=0.2)
    assert sorted(r.id for r in good.collect()) == [1, 3, 4] and "timed out" in dead.first().error
    assert scripts.compiled("def transform_polars(df):\n    return df\n")[1] == "polars"


def test_encryption(spark):
    df = spark.createDataFrame([("Mirko", "4111111111111111"), ("Ulf", None), ("Al", "4111111111111111")], "name string, card string")
    sealed = protect.encrypt_fields(df, ["card"], "k" * 32)
    cards = [r.card for r in sealed.collect()]
    assert cards[1] is None and cards[0] != cards[2]
    good, bad = protect.decrypt_fields(sealed, ["card"], "k" * 32)
    assert [r.card for r in good.collect()] == ["4111111111111111", None, "4111111111111111"] and bad.isEmpty()
    good, bad = protect.decrypt_fields(sealed, ["card"], "x" * 32)
    assert good.count() == 1 and bad.count() == 2
    with pytest.raises(ValueError):
        protect.encrypted(F.col("x"), "short")


def test_array_to_map(spark):
    texts = ['[{"id":"a","v":1},{"id":"b"},{"id":"a","v":2},3,{"v":9}]', "no json", '{"id":"a"}', None, "[]"]
    out = [r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select(columns.array_to_map(F.col("t")).alias("m")).collect()]
    assert out[0] == {"b": '{"id":"b"}', "a": '{"id":"a","v":2}', "4": '{"v":9}'}
    assert out[1:] == [{}, {}, {}, {}]


def test_columns(spark):
    df = spark.createDataFrame([("20240102", "5", 5.0), ("0", "x", 5.5), (None, None, None)], "raw string, n string, f double")
    assert [r.raw for r in columns.reformat_date(df, "raw", target="%d/%m/%Y").collect()] == ["02/01/2024", None, None]
    good, bad = columns.split_casts(df, {"n": "int"})
    assert good.count() == 2 and bad.first()["_error"] == "n: cannot cast to int: x"
    from pyspark.sql import types as T

    assert [r.f for r in columns.coerce_to_schema(df, T._parse_datatype_string("f string")).collect()] == ["5", "5.5", None]
    nested = spark.sql("select struct(1 as inner_id, array(struct(2 as deep_name)) as some_list) as outer_part, 3 as _id")
    assert columns.camel_case_names(nested).schema.simpleString() == "struct<outerPart:struct<innerId:int,someList:array<struct<deepName:int>>>,id:int>"


def test_rules(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "v int")
    assert [r.v for r in rows.apply_rules(df, [{"field": "v", "operator": "not_in", "value": [1]}]).collect()] == [None, 3]
    assert [r.v for r in rows.apply_rules(df, [{"field": "v", "operator": "in", "value": [1, None]}]).collect()] == [1, None]
    assert rows.apply_rules(df.filter("v > 9"), [{"field": "v", "operator": ">", "value": 0}]).isEmpty()
    with pytest.raises(ValueError):
        rows.apply_rules(df, [{"field": "w", "operator": "==", "value": 1}])
    assert rows.apply_rules(df, [{"field": "w", "operator": "==", "value": 1}], skip_unknown=True).count() == 3


def test_enrichment_keeps_rows(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y"), (9, "z")], "k long, name string")
    lookup = spark.createDataFrame([(1, "first", 1), (1, "second", 2), (None, "none", 1)], "k long, name string, v int")
    out = {r.k: r.found for r in enrich.nested(df, lookup, "k", "found", ["v"]).collect()}
    assert out[1].name == "second" and out[None] is None and out[9].asDict() == {"name": None, "v": None}
    assert enrich.nested(df, lookup, "k", "found", ["v"]).filter("k = 9").select(F.to_json("found")).first()[0] == "{}"
    assert enrich.nested(df, lookup, "k", "found").filter("k = 1").first().found.name == "second"  # by all columns
    assert {r.k: r.name for r in enrich.flattened(df, lookup, "k", ["v"]).collect()} == {1: "second", None: "y", 9: "z"}


def test_planning(spark):
    sized = spark.createDataFrame([("claims", 2500, 1)], "source string, row_count long, byte_count long")
    assert planning.parallelism(sized, 1000, 1, 8).first().workers == 3
    assert planning.parallelism(sized.limit(0)).first().shards == 1
    keys = {r.column_name: (r.distinct_values, r.is_key) for r in planning.candidate_keys(spark.sql("select id, id % 3 as third, nullif(id, 4) as gap from range(10)"), ["id", "third", "gap"]).collect()}
    assert keys == {"id": (10, True), "third": (3, False), "gap": (9, False)}
    bounds = [(r.first, r.last) for r in planning.intervals(spark, 10, 3).collect()]
    assert bounds == [(0, 4), (4, 8), (8, 10)]
    df = spark.createDataFrame([("a", b"x" * 200_000)], "g string, data binary")
    assert planning.batch_advice(df, ["g"], F.octet_length("data"), 1000).first().batch_rows == 50


def test_messages_and_routes(spark):
    df = spark.createDataFrame([('{"payload":{"id":1}}',), ("bad",)], "value string")
    assert [r.id for r in messages.parse(df, "id int", payload="payload").collect()] == [1, None]
    routed = sinks.routed(spark.range(3), {"one": "id == 1", "all": None}).collect()
    assert sorted((r.id, r.destination) for r in routed) == [(0, "all"), (1, "all"), (1, "one"), (2, "all")]
    assert registry.resolve(spark, "csv") == "csv"
    with pytest.raises(ValueError):
        registry.resolve(spark, "unknown")
    assert messages.kafka_options("h", "t", offset_action="replay_from_start")["startingOffsets"] == "earliest"


def test_pipeline_run_writes_all_parts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "mirko@post.example", "30"), (2, "nobody", "45"), (3, None, "50"), (4, "d@e.f", "old")], "id long, email string, age string").write.parquet(source)
    spec = {
        "sources": [{"type": "parquet", "path": source}],
        "contract": {"not_null": ["email"], "regex_match": {"email": "[^@]+@[^@]+"}},
        "steps": [{"type": "cast", "column": "age", "target_type": "int"}],
        "destinations": [{"name": "all", "path": str(tmp_path / "out")}, {"name": "none", "path": str(tmp_path / "none"), "condition": "age == 99"}],
        "dead_letters": str(tmp_path / "dead"),
    }
    Pipeline(spec).run(spark)
    assert [(r.id, r.age) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 30)]
    assert spark.read.parquet(str(tmp_path / "none")).isEmpty()
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 3


def people(spark, tmp_path, n=40):
    source = str(tmp_path / "people")
    spark.range(n).selectExpr("id", "if(id % 4 = 0, null, concat('p', id)) as email", "date_format(date_add(date '2024-01-01', int(id)), 'yyyyMMdd') as day").write.parquet(source)
    return {"sources": [{"type": "parquet", "path": source}], "contract": {"not_null": ["email"]}, "dead_letters": str(tmp_path / "dead"), "progress": str(tmp_path / "progress")}


def test_failure_policy_stops_a_run(spark, tmp_path):
    spec = people(spark, tmp_path) | {"destinations": [{"name": "out", "path": str(tmp_path / "out")}]}
    for policy in ({"mode": "stop_on_failure"}, {"mode": "threshold", "run_percent": 20}, {"mode": "threshold", "run_count": 10, "run_percent": 0}, {"mode": "threshold", "chunk_count": 3, "run_percent": 0, "shard": "id div 10"}):
        with pytest.raises(contracts.ContractViolation, match="policy"):
            Pipeline(spec | {"failure_policy": policy}).run(spark)
        assert not (tmp_path / "out").exists()
    for policy in ({"mode": "continue"}, {"mode": "threshold", "run_percent": 26}):
        Pipeline(spec | {"failure_policy": policy}).run(spark)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
    assert {(r.rows_written, r.rows_failed) for r in spark.read.parquet(str(tmp_path / "progress")).collect()} == {(30, 10)}


def test_keyed_destinations(spark, tmp_path):
    spec, target = people(spark, tmp_path), str(tmp_path / "table")
    for mode, rule, tag in (("upsert", [], "a"), ("upsert", [{"field": "id", "operator": "<", "value": 10}], "b"), ("delete", [{"field": "id", "operator": ">", "value": 30}], "c")):
        destination = {"name": "t", "path": target, "mode": mode, "match_keys": ["id"]}
        Pipeline(spec | {"rules": rule, "steps": [{"type": "add_constant", "column": "tag", "value": tag}], "destinations": [destination]}).run(spark)
    found = {r.id: r.tag for r in VersionedTable(spark, target).read().collect()}
    assert found == {k: "b" if k < 10 else "a" for k in range(31) if k % 4}
    feed = spark.createDataFrame([(1, "new", "UPDATE", "1"), (2, None, "DELETE", "2"), (99, "more", "INSERT", "3")], f"id long, tag string, {merge.OP} string, {merge.SEQ} string")
    sinks.load(feed, {"name": "t", "path": target, "mode": "apply_changes", "match_keys": ["id"]})
    found = {r.id: r.tag for r in VersionedTable(spark, target).read().collect()}
    assert found[1] == "new" and 2 not in found and found[99] == "more" and found[3] == "b"
    with pytest.raises(ValueError, match="match_keys"):
        sinks.load(feed, {"name": "t", "path": target, "mode": "upsert"})
    with pytest.raises(ValueError, match="unknown mode"):
        sinks.load(feed, {"name": "t", "path": target, "mode": "merge"})


def test_versioned_table_survives_reopening(spark, tmp_path):
    kind, root = "k long, v long", str(tmp_path / "versions")
    assert VersionedTable(spark, root, kind).read().isEmpty()
    for n in range(4):
        VersionedTable(spark, root, kind).write(spark.createDataFrame([(1, n)], kind), "stream", n)
    assert VersionedTable(spark, root).read().first().v == 3 and VersionedTable(spark, root).versions() == [2, 3]
    VersionedTable(spark, root).write(spark.createDataFrame([(1, 9)], kind), "stream", 3)  # a repeated batch
    assert VersionedTable(spark, root).read().first().v == 3
    VersionedTable(spark, root).write(spark.createDataFrame([(1, 7)], kind), "another", 0)  # a stream of its own
    assert VersionedTable(spark, root).read().first().v == 7 and VersionedTable(spark, root).ledger() == {"stream": 3, "another": 0}
    (tmp_path / "versions" / "data" / "half" / "_bucket=0").mkdir(parents=True)  # a crash before the commit leaves no version
    assert VersionedTable(spark, root).read().first().v == 7


def test_step_options(spark):
    df = spark.createDataFrame([("20240131", 1)], "day string, n int")
    for source, target in (("source_format", "target_format"), ("input_format", "output_format")):
        out = Pipeline({"steps": [{"type": "date_format", "field": "day", source: "%Y%m%d", target: "%d/%m/%Y"}]}).apply(df).good
        assert out.first().day == "31/01/2024"
    with pytest.raises(ValueError, match="unknown step type"):
        Pipeline({"steps": [{"type": "explode", "column": "day"}]})
    with pytest.raises(ValueError, match="unknown options"):
        Pipeline({"steps": [{"type": "date_format", "field": "day", "sourceformat": "%Y"}]})
    chain = Pipeline({"steps": [{"type": "script", "code": "def transform_records(rows):\n    return [dict(r, n=r['n'] + 1) for r in rows]\n"}, {"type": "plugin", "name": "twice"}]})
    chain.plugins.load("twice", lambda batch: batch.take([0, 0]), df.schema)
    assert [r.n for r in chain.apply(df).good.collect()] == [2, 2]


def test_keys_of_a_database(spark):
    url = "jdbc:derby:memory:keys;create=true"
    jdbc.append(spark.createDataFrame([(1,)], "WARM long"), url, "WARM")  # loads the driver
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    statement = connection.createStatement()
    statement.execute("CREATE TABLE PARENT (ID BIGINT PRIMARY KEY, NAME VARCHAR(10))")
    statement.execute("CREATE TABLE CHILD (A BIGINT, B BIGINT, P BIGINT REFERENCES PARENT (ID), PRIMARY KEY (A, B))")
    connection.close()
    assert {(r.kind, r.column_name, r.position, r.parent_table, r.parent_column) for r in jdbc.keys(spark, url, "CHILD").collect()} == {("primary", "A", 1, None, None), ("primary", "B", 2, None, None), ("foreign", "P", 1, "PARENT", "ID")}


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "parts")
    sinks.replace(spark.sql("select id, id % 3 as p from range(9)"), path, by=["p"])
    sinks.replace(spark.sql("select 100 as id, 1 as p"), path, by=["p"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 2, 3, 5, 6, 8, 100]


def test_rolled_files(spark, tmp_path):
    path = str(tmp_path / "rolled")
    df = spark.range(1000).repartition(1)
    assert sinks.rolling(df, path, max_rows=300, prefix="x") == 4 and sinks.rolling(df, path, max_bytes=4000, prefix="x") == 2
    assert sorted(p.name for p in (tmp_path / "rolled").glob("x_*")) == [f"x_{k:05d}.parquet" for k in range(1, 7)]
    assert spark.read.parquet(path).count() == 2000
