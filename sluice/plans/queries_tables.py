"""Queries of sources, sinks, filters, column steps and protection, each with its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.scratch import shared_path
from sluice.operators import columns, enrich, merge, planning, protect, rows
from sluice.sources import files, jdbc, messages, registry, sinks, zipcsv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY = "0123456789abcdef0123456789abcdef"
KEYS = {1: "0123456789abcdef0123456789abcdef", 2: "fedcba9876543210fedcba9876543210"}


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return files.parquet(spark, f"{sf_dir}/{name}.parquet")


def micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


# Sources


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(spark, sf_dir):
    path, df = shared_path(spark), table(spark, sf_dir, "customer")
    sinks.csv(df, path)
    return files.csv(spark, path, schema=df.schema)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_csv_gz(spark, sf_dir):
    path, df = shared_path(spark), table(spark, sf_dir, "supplier")
    sinks.csv(df, path, compression="gzip")
    return files.csv(spark, path, schema=df.schema)


@query("SELECT * FROM part")
def scan_zip_csv(spark, sf_dir):
    path, df = shared_path(spark), table(spark, sf_dir, "part")
    zipcsv.write(df, path)
    return zipcsv.read(spark, path, df.schema)


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def scan_parquet(spark, sf_dir):
    return rows.where(files.parquet(spark, f"{sf_dir}/lineitem.parquet"), "l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_quantity")


def _derby(spark, df: DataFrame, name: str) -> str:
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    jdbc.append(df.toDF(*[c.upper() for c in df.columns]), url, name)
    return url


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def scan_jdbc(spark, sf_dir):
    url = _derby(spark, table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "CUSTOMER")
    return columns.lowercase_names(jdbc.read(spark, url, "SELECT * FROM CUSTOMER WHERE C_ACCTBAL > 0"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_sharded(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    url = _derby(spark, df, "ORDERS")
    first, last = df.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return columns.lowercase_names(jdbc.read_sharded(spark, url, "ORDERS", "O_ORDERKEY", first or 0, (last or 0) + 1, 8))


@query("SELECT c_mktsegment, count(*) AS n, CAST(round(sum(o_totalprice) * 100) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def sql_source(spark, sf_dir):
    text = "SELECT c_mktsegment, count(*) AS n, CAST(round(sum(o_totalprice) * 100) AS BIGINT) AS cents FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment"
    return files.query(spark, text, {t: table(spark, sf_dir, t) for t in ("orders", "customer")})


@query("SELECT event_id, user_id, value FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00'")
def delta_scan_ts(spark, sf_dir):
    from sluice.operators import changes

    return changes.after(table(spark, sf_dir, "events"), "ts", "2024-01-15 12:00:00").select("event_id", "user_id", "value")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 700")
def delta_scan_id(spark, sf_dir):
    from sluice.operators import changes

    return changes.after(table(spark, sf_dir, "orders"), "o_orderkey", 700).select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey > 20")
def scan_documents(spark, sf_dir):
    path, df = shared_path(spark), table(spark, sf_dir, "customer")
    sinks.append(df, path, "json")
    return files.documents(spark, path, df.schema, "c_mktsegment = 'BUILDING'", ["c_custkey", "c_name", "c_acctbal"], ("c_custkey", 20), "c_custkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def ingest_json_bodies(spark, sf_dir):
    return messages.ingest_bodies(table(spark, sf_dir, "events"), "props", T.StructType([T.StructField("k", T.LongType())]), keep=["event_id"])


@query("SELECT event_id, user_id, event_type, value FROM events")
def parse_json_messages(spark, sf_dir):
    sent = messages.publishable(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), "event_id")
    return messages.parse(sent, "event_id long, user_id long, event_type string, value double")


@query("SELECT event_id, event_type, value FROM events")
def pluggable_stream_source(spark, sf_dir):
    source, out = shared_path(spark), shared_path(spark)
    messages.publishable(table(spark, sf_dir, "events").select("event_id", "event_type", "value")).select("value").write.text(source)
    lines = messages.stream(spark, registry.resolve(spark, "files"), path=source, files_per_batch="4")
    parsed = messages.parse(lines, "event_id long, event_type string, value double")
    run = parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark)).trigger(processingTime="0 seconds").start()
    run.processAllAvailable()
    run.stop()
    return spark.read.parquet(out)


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 'customers' AS _source FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'suppliers' FROM supplier")
def multi_source_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return rows.union_sources({"customers": a, "suppliers": b})


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def sample_limit(spark, sf_dir):
    return rows.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, "o_totalprice", "o_orderkey")


@query('SELECT c_custkey AS "cCustkey", c_name AS "cName", c_mktsegment AS "cMktsegment" FROM customer WHERE c_custkey = 42')
def point_lookup(spark, sf_dir):
    return columns.camel_case_names(rows.by_id(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", 42))


# Sinks


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier")
def sink_append(spark, sf_dir):
    path, df = shared_path(spark), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    sinks.append(df, path)
    sinks.append(df, path)
    return spark.read.parquet(path)


BEFORE = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'"
NOW = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS o_totalprice FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01')"


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """An earlier state of the orders, without the newest; and a later one, without old finished ones and with new prices."""
    o = table(spark, sf_dir, "orders")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    raised = F.col("o_totalprice") + F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0)
    return o.filter("o_orderdate < timestamp_ntz'2001-01-01 00:00:00'").select(*cols), o.filter("not (o_orderstatus = 'F' and o_orderdate < timestamp_ntz'1996-01-01 00:00:00')").withColumn("o_totalprice", raised).select(*cols)


@query(f"WITH a AS ({BEFORE}), b AS ({NOW}) SELECT * FROM b UNION ALL SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def upsert_merge(spark, sf_dir):
    before, now = snapshots(spark, sf_dir)
    return merge.upsert(before, now, ["o_orderkey"], ["o_totalprice"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_by_key(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return merge.delete(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


FEED = "SELECT user_id, event_id, value, ts, CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'signup' THEN 'INSERT' ELSE 'UPDATE' END AS op FROM events"


def change_feed(spark, sf_dir) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "signup", "INSERT").otherwise("UPDATE")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts", op.alias(merge.OP))


@query(f"""WITH feed AS ({FEED}), last AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT c_custkey AS user_id, CAST(-1 AS BIGINT) AS event_id, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM last)
UNION ALL SELECT user_id, event_id, value FROM last WHERE op <> 'DELETE'""")
def cdc_apply(spark, sf_dir):
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(-1).cast("bigint").alias("event_id"), F.col("c_acctbal").alias("value"))
    return merge.apply_changes(target, change_feed(spark, sf_dir), ["user_id"], ["ts", "event_id"])


@query("""WITH s AS (SELECT nullif(p_partkey, 7) AS p_partkey, upper(p_name) AS p_name, p_retailprice * 2 AS p_retailprice FROM part WHERE p_size > 25)
SELECT p_partkey, p_name, p_retailprice FROM s WHERE p_partkey IS NOT NULL
UNION ALL SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM s WHERE p_partkey IS NOT NULL)""")
def document_upsert(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    new = p.filter("p_size > 25").select(F.expr("nullif(p_partkey, 7)").alias("p_partkey"), F.upper("p_name").alias("p_name"), (F.col("p_retailprice") * 2).alias("p_retailprice"))
    return merge.upsert_documents(p.select("p_partkey", "p_name", "p_retailprice"), new, "p_partkey", ["p_retailprice"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_nationkey AS nation FROM customer")
def publish_json(spark, sf_dir):
    sent = messages.publishable(table(spark, sf_dir, "customer"), "c_custkey")
    return sent.select("key", F.get_json_object("value", "$.c_name").alias("name"), F.get_json_object("value", "$.c_nationkey").cast("int").alias("nation"))


@query("SELECT event_id, user_id AS shard, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS batch FROM events")
def message_batches(spark, sf_dir):
    return messages.batches(table(spark, sf_dir, "events").select("event_id", "user_id"), F.col("user_id"), ["event_id"]).select("event_id", "shard", "batch")


@query("SELECT CAST(event_id AS VARCHAR) AS key, event_id, value, true AS within FROM events")
def publish_groups(spark, sf_dir):
    """Messages handed to a broker's client from the tasks, in groups of at most ten."""
    folder = shared_path(spark)
    told = {"format": "groups", "key": "event_id", "options": {"sender": "sluice.sources.rollwriter:FolderSender", "folder": folder, "size": "10"}}
    sinks.load(table(spark, sf_dir, "events").select("event_id", "value").repartition(4, "event_id"), {"name": "broker", "publish": told})
    groups = spark.read.text(folder).select(F.from_json("value", "array<struct<key:string,value:string>>").alias("g"))
    sent = groups.select(F.explode("g").alias("m"), (F.size("g") <= 10).alias("within"))
    return sent.select("m.key", F.from_json("m.value", "event_id long, value double").alias("v"), "within").select("key", "v.event_id", "v.value", "within")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sink_csv(spark, sf_dir):
    path, df = shared_path(spark), table(spark, sf_dir, "nation")
    sinks.csv(df, path, "overwrite")
    return files.csv(spark, path, schema=df.schema)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def sink_parquet(spark, sf_dir):
    path = shared_path(spark)
    sinks.parquet(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), path)
    return files.parquet(spark, path)


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def sink_csv_round_trip(spark, sf_dir):
    path = shared_path(spark)
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    sinks.csv(df, path, "overwrite")
    return files.csv(spark, path, schema=df.schema)


@query("SELECT count(*) AS n, true AS within, true AS named FROM lineitem")
def sink_rolling_bytes(spark, sf_dir):
    path, df = shared_path(spark), table(spark, sf_dir, "lineitem")
    made = sinks.rolling(df, path, max_bytes=200_000, prefix="lines") + sinks.rolling(df.limit(0), path, max_bytes=200_000, prefix="lines")
    size = planning.row_bytes(df)
    per_file = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    named = F.max(F.when(F.col("f").rlike("/lines_[0-9]{5}[.]parquet$"), 0).otherwise(1)) == 0
    return per_file.agg(F.sum("n").alias("n"), ((F.max("b") < 250_000) & (F.count("*") <= made)).alias("within"), named.alias("named"))


@query("SELECT count(*) AS n, true AS within FROM orders")
def sink_rolling_files(spark, sf_dir):
    path = shared_path(spark)
    sinks.rolling(table(spark, sf_dir, "orders"), path, max_rows=1000)
    per_file = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return per_file.agg(F.sum("n").alias("n"), (F.max("n") <= 1000).alias("within"))


@query("""SELECT o_orderkey, 'open' AS destination FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, 'large' FROM orders WHERE o_totalprice > 400000
UNION ALL SELECT o_orderkey, 'all' FROM orders""")
def fanout_route(spark, sf_dir):
    return sinks.routed(table(spark, sf_dir, "orders"), {"open": "o_orderstatus == 'O'", "large": "o_totalprice > 400000", "all": None}).select("o_orderkey", "destination")


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders, CAST(round(coalesce(sum(o_totalprice), 0) * 100) AS BIGINT) AS cents, coalesce(min(o_orderkey), -1) AS first_order
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def consolidate_documents(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    docs = enrich.consolidate(table(spark, sf_dir, "customer"), orders, "c_custkey", "orders", ["o_orderkey"])
    total = F.aggregate("orders", F.lit(0.0), lambda a, x: a + x["o_totalprice"])
    return docs.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), F.coalesce(F.try_element_at("orders", F.lit(1))["o_orderkey"], F.lit(-1)).alias("first_order"), F.round(total * 100).cast("bigint").alias("cents"))


# Filters and columns


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'P'")
def filter_expr(spark, sf_dir):
    return rows.where(table(spark, sf_dir, "orders"), "o_totalprice > 100000 and o_orderstatus <> 'P'").select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 300000 AND o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'")
def rules_compare(spark, sf_dir):
    rules = [{"field": f, "operator": o, "value": v} for f, o, v in (("o_totalprice", ">=", 50000), ("o_totalprice", "<", 300000), ("o_orderstatus", "==", "O"), ("o_orderpriority", "!=", "5-LOW"))]
    return rows.apply_rules(table(spark, sf_dir, "orders"), rules).select("o_orderkey", "o_totalprice")


def _segments(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("seg", F.expr("nullif(c_mktsegment, 'BUILDING')"))


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')")
def rules_in(spark, sf_dir):
    return rows.apply_rules(_segments(spark, sf_dir), [{"field": "seg", "operator": "in", "value": ["MACHINERY", None]}]).select("c_custkey", "seg")


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'FURNITURE')")
def rules_not_in_null(spark, sf_dir):
    return rows.apply_rules(_segments(spark, sf_dir), [{"field": "seg", "operator": "not_in", "value": ["MACHINERY", "FURNITURE"]}]).select("c_custkey", "seg")


@query("SELECT p_name, p_partkey FROM part")
def select_columns(spark, sf_dir):
    return columns.select_columns(table(spark, sf_dir, "part"), ["p_name", "unknown", "p_partkey"])


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part")
def drop_columns(spark, sf_dir):
    return columns.drop_columns(table(spark, sf_dir, "part"), ["p_type", "p_retailprice", "unknown"])


@query("SELECT s_suppkey AS id, s_name AS title, s_nationkey, s_acctbal FROM supplier")
def rename_columns(spark, sf_dir):
    return columns.rename_columns(table(spark, sf_dir, "supplier"), {"s_suppkey": "id", "s_name": "title", "unknown": "x"})


@query("SELECT doc_id, TRY_CAST(substr(source, 4) AS BIGINT) AS number FROM documents")
def cast_columns(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.substring("source", 4, 10).alias("number"))
    return columns.cast_column(df, "number", "int64")


def _statuses(spark, sf_dir) -> DataFrame:
    code = F.when(F.col("o_orderstatus") == "P", F.lit("bad")).otherwise(F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code"))


@query("SELECT o_orderkey, 'bad' AS code, 'code: cannot cast to bigint: bad' AS error FROM orders WHERE o_orderstatus = 'P'")
def cast_dlq(spark, sf_dir):
    _, bad = columns.split_casts(_statuses(spark, sf_dir), {"code": "int64"})
    return bad.select("o_orderkey", "code", F.col("_error").alias("error"))


@query("SELECT r_regionkey, r_name, 'eu' AS zone FROM region")
def add_constant(spark, sf_dir):
    return columns.add_constant(table(spark, sf_dir, "region"), "zone", "eu")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' OR o_orderpriority = '1-URGENT' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def date_reformat(spark, sf_dir):
    text = F.when(F.col("o_orderpriority") == "5-LOW", "0").when(F.col("o_orderpriority") == "1-URGENT", "bad").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("raw"))
    return columns.reformat_date(df, "raw", into="day").select("o_orderkey", "day")


@query("SELECT n_nationkey, n_name FROM nation")
def lowercase_names(spark, sf_dir):
    return columns.lowercase_names(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("N_NationKey"), F.col("n_name").alias("N_NAME")))


@query('SELECT o_orderkey AS "oOrderkey", o_orderpriority AS "oOrderpriority" FROM orders')
def camel_case_names(spark, sf_dir):
    return columns.camel_case_names(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"))


@query("""SELECT o_orderkey AS "OOrderkey", strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ordered, CAST(o_custkey AS VARCHAR) AS customer, o_totalprice * 2 AS double_price FROM orders""")
def schema_mapping(spark, sf_dir):
    mappings = [{"source": "o_orderdate", "target": "ordered", "type": "date_iso"}, {"source": "o_custkey", "target": "customer", "type": "type_str"}, {"source": "o_totalprice", "target": "double_price", "type": "function", "expression": "o_totalprice * 2"}]
    return columns.map_schema(table(spark, sf_dir, "orders"), mappings, exclude=("o_orderstatus", "o_orderpriority"))


@query("SELECT c_custkey, upper(c_mktsegment) || ':' || c_nationkey AS label FROM customer")
def row_expression(spark, sf_dir):
    return columns.row_expression(table(spark, sf_dir, "customer"), "label", "concat(upper(c_mktsegment), ':', c_nationkey)").select("c_custkey", "label")


@query("SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS item, max(l_quantity) AS qty FROM lineitem GROUP BY ALL")
def array_to_map(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("qty"))))).alias("items"))
    return items.select("l_orderkey", F.explode(columns.array_to_map(F.col("items"))).alias("item", "v")).select("l_orderkey", "item", F.get_json_object("v", "$.qty").cast("double").alias("qty"))


@query("""SELECT l_orderkey, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS l_quantity,
CAST(trunc(l_extendedprice) AS BIGINT) AS l_extendedprice, CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem""")
def coerce_to_schema(spark, sf_dir):
    return columns.coerce_to_schema(table(spark, sf_dir, "lineitem"), T._parse_datatype_string("l_orderkey bigint, l_quantity string, l_extendedprice bigint, l_linenumber double"))


@query("SELECT upper(c_name) AS c_name, '***-**-' || right(CAST(c_custkey AS VARCHAR), 4) AS c_custkey, sha256(c_mktsegment) AS c_mktsegment, 'PAT-' || c_nationkey AS c_nationkey FROM customer")
def mask_columns(spark, sf_dir):
    masks = {"c_name": "upper", "c_custkey": "last4", "c_mktsegment": "sha256", "c_nationkey": "prefix:PAT-"}
    return columns.mask(table(spark, sf_dir, "customer"), masks).select(*masks)


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part")
def flatten_to_text(spark, sf_dir):
    return columns.flatten_to_text(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"))


@query("SELECT '***REDACTED***' AS c_custkey, c_name, '***REDACTED***' AS c_nationkey FROM customer")
def redact_columns(spark, sf_dir):
    return protect.redacted(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def drop_nulls(spark, sf_dir):
    return rows.drop_nulls(_segments(spark, sf_dir), ["seg"]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def rule_not_null(spark, sf_dir):
    from sluice.operators import contracts

    return contracts.validate(_segments(spark, sf_dir), {"not_null": ["seg"]})[0].select("c_custkey")


@query()
def ingested_at(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.current_timestamp().alias("ingested_at"))


# Protection


@query("SELECT c_custkey, CAST(4 * ceil((28 + length(c_name)) / 3.0) AS INTEGER) AS size, true AS differs FROM customer")
def encrypt_fields(spark, sf_dir):
    sealed = protect.encrypt_fields(rows.spread(table(spark, sf_dir, "customer")).withColumn("plain", F.col("c_name")), ["c_name"], KEY)
    return sealed.select("c_custkey", F.length("c_name").alias("size"), (F.col("c_name") != F.col("plain")).alias("differs"))


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def decrypt_fields(spark, sf_dir):
    sealed = protect.encrypt_fields(rows.spread(table(spark, sf_dir, "customer")).select("c_custkey", "c_name", "c_nationkey"), ["c_name", "c_nationkey"], KEY)
    return protect.decrypt_fields(sealed, ["c_name", "c_nationkey"], KEY)[0]


@query("SELECT c_custkey, 'c_name: cannot decrypt' AS error FROM customer")
def decrypt_wrong_key_dlq(spark, sf_dir):
    sealed = protect.encrypt_fields(rows.spread(table(spark, sf_dir, "customer")).select("c_custkey", "c_name"), ["c_name"], KEY)
    return protect.decrypt_fields(sealed, ["c_name"], KEYS[2])[1].select("c_custkey", F.col("_error").alias("error"))


@query("SELECT s_suppkey, s_name AS secret, 2 AS version FROM supplier")
def rotate_key_versions(spark, sf_dir):
    tenant = F.lit("tenant")
    df = rows.spread(table(spark, sf_dir, "supplier")).select("s_suppkey", protect.seal(F.col("s_name"), KEYS, 1, tenant).alias("token"))
    new = protect.rotate_keys(df, "token", KEYS, tenant)
    return new.select("s_suppkey", protect.unseal(F.col("token"), KEYS, tenant).alias("secret"), F.regexp_extract("token", "^enc:v(\\d+):", 1).cast("int").alias("version"))
