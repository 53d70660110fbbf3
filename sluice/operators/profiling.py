"""Profiles of tables: keys of several columns, inclusions, ranges of equal depth, and counts from Parquet footers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Relative error of the sketches, and by how many of its deviations a sketch may fall short of what it is compared with.
ERROR, SLACK = 0.02, 4
COMPARED = (T.IntegralType, T.StringType, T.DateType, T.DecimalType)
#: Rows of a task where nearly each row is a group of its own, and how many it may hold before the shuffle takes the longer way of writing.
ROWS, MOST_ROWS = 500_000, 2_000_000


def _sketch(*columns: str) -> Column:
    return F.approx_count_distinct(F.struct(*[f"`{c}`" for c in columns]), ERROR)


def dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """So many rows dealt by columns over tasks of ROWS each, to be grouped by them.

    The number of tasks follows from the rows, not from the session's shuffle partitions, so the memory of one does not grow with the
    table. Groups meet here without partial sums, which save nothing where nearly all keys differ and would hold a whole split's keys.
    Nor do writing tasks hold a split while a shuffle has few enough partitions to write each straight to a file; up to MOST_ROWS a task
    they stay that few. Beyond, a writing task sorts the rows of its split, which the table's size does not change, and spills.
    """
    straight = int(df.sparkSession.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    tasks = min(-(-rows // ROWS), max(straight, -(-rows // MOST_ROWS)))
    return df.repartition(max(1, tasks), *[F.col(f"`{c}`") for c in columns])


def composite_keys(df: DataFrame, columns: list[str], most: int = 3) -> DataFrame:
    """Minimal sets of at most so many columns that have no nulls and tell all rows apart: columns, as a sorted array.

    Levels of one, two and more columns are gone through. A level's sets are sketched together in one pass, which leaves few;
    these are confirmed by exact counts in tasks of bounded size. Sets that hold a key are not looked at, nor are columns with
    nulls. No rows have every single column as a key. The rows are gone over several times, so derived ones are better stored before.
    """
    counts = df.agg(F.count("*").alias("n"), *[F.count(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)]).first()
    whole = sorted(c for i, c in enumerate(columns) if counts[f"k{i}"] == counts["n"])
    found: list[tuple[str, ...]] = []
    for size in range(1, most + 1):
        sets = [s for s in combinations(whole, size) if not any(set(k) <= set(s) for k in found)]
        if not sets:
            break
        guessed = df.agg(*[_sketch(*s).alias(f"s{i}") for i, s in enumerate(sets)]).first()
        likely = [s for i, s in enumerate(sets) if guessed[f"s{i}"] >= counts["n"] * (1 - SLACK * ERROR)]
        for s in likely:
            keys = dealt(df.select(*[f"`{c}`" for c in s]), counts["n"], *s)
            if keys.groupBy(*[f"`{c}`" for c in s]).agg(F.count("*").alias("_rows")).where("_rows > 1").isEmpty():
                found.append(s)
    return df.sparkSession.createDataFrame([(list(s),) for s in found], "columns array<string>")


def inclusions(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns all of whose values occur in a column of another table, whatever their names: child and parent table and column, and distinct values.

    One pass a table sketches the distinct values, the least and the largest of each column. A pair of equal types is
    tried only if the child's range lies in the parent's and its sketch does not exceed the parent's; an exact anti join of
    distinct values decides. Columns without values are left out.
    """
    kinds = {(t, f.name): f.dataType for t, df in tables.items() for f in df.schema if isinstance(f.dataType, COMPARED)}
    seen: dict[tuple[str, str], tuple] = {}
    for t, df in tables.items():
        mine = [c for table, c in kinds if table == t]
        if mine:
            what = [x for i, c in enumerate(mine) for x in (F.approx_count_distinct(f"`{c}`", ERROR).alias(f"d{i}"), F.min(f"`{c}`").alias(f"a{i}"), F.max(f"`{c}`").alias(f"z{i}"))]
            row = df.agg(*what).first()
            seen |= {(t, c): (row[f"d{i}"], row[f"a{i}"], row[f"z{i}"]) for i, c in enumerate(mine)}
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for a, (many, low, high) in seen.items():
        for b, (others, least, last) in seen.items():
            if a[0] == b[0] or kinds[a] != kinds[b] or low is None or least is None:
                continue
            if low < least or high > last or many * (1 - SLACK * ERROR) > others * (1 + SLACK * ERROR):
                continue
            child = tables[a[0]].select(F.col(f"`{a[1]}`").alias("v")).where("v is not null").distinct()
            parent = tables[b[0]].select(F.col(f"`{b[1]}`").alias("v")).distinct().withColumn("held", F.lit(True))
            rows = child.join(parent, "v", "left").agg(F.count("*").alias("distinct_values"), F.count(F.when(F.col("held").isNull(), 1)).alias("missing"))
            names = zip((*a, *b), ("child_table", "child_column", "parent_table", "parent_column"), strict=True)
            parts.append(rows.where("missing = 0").select(*[F.lit(x).alias(n) for x, n in names], "distinct_values"))
    schema = "child_table string, child_column string, parent_table string, parent_column string, distinct_values long"
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def depth_bounds(df: DataFrame, column: str, shards: int) -> list:
    """Values of a column that cut it into at most so many half-open ranges of about equally many rows: a sketch of quantiles, whatever the skew.

    A value is never cut, so one that holds more rows than a range stands alone. Fewer bounds than shards less one come of few values.
    """
    if shards < 2:
        return []
    found = df.agg(F.percentile_approx(f"`{column}`", [k / shards for k in range(1, shards)], 10_000)).first()[0]
    return sorted(set(found or []))


def depth_ranges(df: DataFrame, column: str, shards: int) -> DataFrame:
    """The ranges of depth_bounds: shard, first (null: open) and last, exclusive (null: open)."""
    bounds = depth_bounds(df, column, shards)
    kind = T.StructType([T.StructField("shard", T.IntegerType()), *[T.StructField(n, df.schema[column].dataType) for n in ("first", "last")]])
    return df.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip([None, *bounds], [*bounds, None], strict=True))], kind)


def literal(value: object) -> str:
    return str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


def range_predicates(column: str, bounds: list) -> list[str]:
    """Conditions of the ranges in a database's SQL; null keys are in the first."""
    if not bounds:
        return ["1 = 1"]
    inner = [f"{column} >= {literal(a)} AND {column} < {literal(b)}" for a, b in zip(bounds, bounds[1:], strict=False)]
    return [f"{column} < {literal(bounds[0])} OR {column} IS NULL", *inner, f"{column} >= {literal(bounds[-1])}"]


def footers(spark: SparkSession, path: str) -> DataFrame:
    """What the Parquet footers under a path say of each file and column: file, rows, file_bytes, column, nulls, least and most as text.

    Footers are read in tasks, through Arrow's file systems; no column is read. Columns without statistics have nulls there.
    """
    from pyarrow import fs

    from sluice.functions.scratch import tree

    files = tree(spark, path, ".parquet")
    schema = "file string, rows long, file_bytes long, column string, nulls long, least string, most string"
    if not files:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, inner = fs.FileSystem.from_uri(name)
                with system.open_input_file(inner) as data:
                    meta = pq.read_metadata(data)
                groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
                for c in range(meta.num_columns):
                    stats = [g.column(c).statistics for g in groups]
                    told = bool(stats) and all(s is not None for s in stats)
                    ends = [s for s in stats if s is not None and s.has_min_max]
                    nulls = sum(s.null_count for s in stats) if told and all(s.has_null_count for s in stats) else None
                    # A group of nulls alone has no ends.
                    sure = told and all(s.has_min_max or s.null_count == g.num_rows for s, g in zip(stats, groups, strict=True))
                    least, most = (str(min(s.min for s in ends)), str(max(s.max for s in ends))) if sure and ends else (None, None)
                    out.append({"file": name, "rows": meta.num_rows, "file_bytes": size, "column": meta.schema.column(c).path, "nulls": nulls, "least": least, "most": most})
            kinds = {"string": pa.string(), "long": pa.int64()}
            yield pa.RecordBatch.from_pylist(out, pa.schema([(n, kinds[k]) for n, k in map(str.split, schema.split(", "))]))

    return spark.createDataFrame(files, "file string, size long").repartition(min(len(files), 1000)).mapInArrow(read, schema)


def footer_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows, bytes and files under a path, from the footers."""
    each = footers(spark, path).groupBy("file").agg(F.first("rows").alias("rows"), F.first("file_bytes").alias("bytes"))
    return each.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))
