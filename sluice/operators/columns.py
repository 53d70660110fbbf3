"""Column steps: choosing, naming, casting, dates, masking and flattening."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.text import as_text, camel, pascal, reformatted

#: Names of cast targets and their types; any other name means text.
TYPES = {
    **dict.fromkeys(("int8", "uint8"), "smallint"),
    "int16": "smallint",
    **dict.fromkeys(("int32", "int", "integer", "uint16"), "int"),
    **dict.fromkeys(("int64", "bigint", "long", "uint32"), "bigint"),
    "uint64": "decimal(20,0)",
    **dict.fromkeys(("float32",), "float"),
    **dict.fromkeys(("float64", "float", "double"), "double"),
    **dict.fromkeys(("boolean", "bool"), "boolean"),
    "date": "date",
    **dict.fromkeys(("datetime", "timestamp"), "timestamp"),
    "binary": "binary",
    "decimal": "decimal(38,18)",
}


def spark_type(name: str) -> str:
    return TYPES.get(name.lower(), "string")


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Listed columns in that order; unknown ones are ignored, and if none is known nothing changes."""
    known = [c for c in columns if c in df.columns]
    return df.select(*known) if known else df


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns})


def add_constant(df: DataFrame, column: str, value) -> DataFrame:
    return df.withColumn(column, F.lit(value))


def cast_column(df: DataFrame, column: str, target: str) -> DataFrame:
    """Cast where possible; what cannot be cast becomes null. Use split_casts to route such rows away."""
    return df.withColumn(column, F.col(column).try_cast(spark_type(target))) if column in df.columns else df


def split_casts(df: DataFrame, targets: dict[str, str], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Rows whose casts all succeed, cast; and the other rows as they were, with the reason in _error."""
    targets = {c: spark_type(t) for c, t in targets.items() if c in df.columns}
    errors = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.concat(F.lit(f"{c}: cannot cast to {t}: "), F.col(c).cast("string"))) for c, t in targets.items()]
    marked = keep(df.withColumn("_error", F.concat_ws("; ", *errors)))
    good = marked.filter("_error = ''").drop("_error").withColumns({c: F.col(c).try_cast(t) for c, t in targets.items()})
    return good, marked.filter("_error <> ''")


def reformat_date(df: DataFrame, column: str, source: str = "%Y%m%d", target: str = "%Y-%m-%d", into: str | None = None) -> DataFrame:
    """Dates of one text pattern in another; with `into` the source column stays."""
    return df.withColumn(into or column, reformatted(F.col(column), source, target)) if column in df.columns else df


def lowercase_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def _renamed(kind: T.DataType, name) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(name(f.name), _renamed(f.dataType, name), f.nullable) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_renamed(kind.elementType, name), kind.containsNull)
    return kind


def camel_case_names(df: DataFrame) -> DataFrame:
    """Names in camelCase, through structs and lists; a cast to the renamed type, so no value is rebuilt."""
    return df.select(*[F.col(f"`{f.name}`").cast(_renamed(f.dataType, camel)).alias(camel(f.name)) for f in df.schema])


def map_schema(df: DataFrame, mappings: list[dict], exclude: tuple[str, ...] = ()) -> DataFrame:
    """One select from mappings {source, target?, type}: direct, rename, date_ymd, date_iso, type_int, type_float, type_str, function.

    Columns without a mapping get their PascalCase name; excluded ones are left out.
    """
    by_source = {m["source"]: m for m in mappings}

    def mapped(c: str) -> Column:
        m = by_source.get(c, {"type": "direct"})
        col = F.col(f"`{c}`")
        out = {
            "date_ymd": lambda: reformatted(col, "%Y%m%d", "%Y-%m-%d"),
            "date_iso": lambda: F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"),
            "type_int": lambda: col.try_cast("bigint"),
            "type_float": lambda: col.try_cast("double"),
            "type_str": lambda: as_text(col, df.schema[c].dataType),
            "function": lambda: F.expr(m["expression"]),
        }.get(m["type"], lambda: col)()
        return out.alias(m.get("target") or pascal(c))

    return df.select(*[mapped(c) for c in df.columns if c not in exclude])


def row_expression(df: DataFrame, target: str, expression: str) -> DataFrame:
    """A column from a SQL expression over the row; nested results become JSON text."""
    with_it = df.withColumn(target, F.expr(expression))
    kind = with_it.schema[target].dataType
    return with_it.withColumn(target, F.to_json(target)) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else with_it


def coerce_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns that the target has, in its types; text from floating numbers drops an empty fraction, integers truncate."""
    out = []
    for field in schema:
        if field.name not in df.columns:
            continue
        col, kind = F.col(field.name), df.schema[field.name].dataType
        if isinstance(field.dataType, T.StringType):
            col = as_text(col, kind)
        elif isinstance(field.dataType, T.IntegralType) and isinstance(kind, T.StringType):
            col = col.try_cast("double").try_cast(field.dataType)
        else:
            col = col.try_cast(field.dataType)
        out.append(col.alias(field.name))
    return df.select(*out)


def mask(df: DataFrame, masks: dict[str, str]) -> DataFrame:
    """Masks by column: upper, last4, first4, sha256, or prefix:<text>."""
    kinds = {
        "upper": F.upper,
        "last4": lambda c: F.concat(F.lit("***-**-"), F.right(c, F.lit(4))),
        "first4": lambda c: F.substring(c, 1, 4),
        "sha256": lambda c: F.sha2(c, 256),
    }
    new = {}
    for c, kind in masks.items():
        text = F.col(c).cast("string")
        new[c] = F.concat(F.lit(kind[7:]), text) if kind.startswith("prefix:") else kinds[kind](text)
    return df.withColumns(new)


def flatten_to_text(df: DataFrame) -> DataFrame:
    """Every field as text: nested values as JSON."""
    return df.select(*[(F.to_json(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f.name).cast("string")).alias(f.name) for f in df.schema])


def array_to_map(col: Column, key: str = "id") -> Column:
    """JSON text of a list of objects as a map from each object's key, or its place, to the object's JSON.

    Bad JSON and other values than lists give an empty map; items that are not objects are skipped but counted; of
    equal keys the last wins.
    """
    items = F.from_json(F.when(F.ltrim(col).startswith("["), col), "array<string>")
    keyed = F.transform(items, lambda x, i: F.struct(F.coalesce(F.get_json_object(x, f"$.{key}"), i.cast("string")).alias("k"), x.alias("v"), i.alias("i")))
    objects = F.filter(keyed, lambda x: F.ltrim(x["v"]).startswith("{"))
    # Sorted by key and place, an object is the last of its key where its neighbour has another one.
    ordered = F.array_sort(F.transform(objects, lambda x: F.struct(x["k"].alias("k"), x["i"].alias("i"), x["v"].alias("v"))))
    pairs = F.transform(F.array(ordered), lambda s: F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda x, y: F.when(y.isNull() | (x["k"] != y["k"]), F.struct(x["k"], x["v"]))))[0]
    return F.map_from_entries(F.coalesce(F.filter(pairs, lambda x: x.isNotNull()), F.array().cast("array<struct<k:string,v:string>>")))
