"""Text and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Date directives and their Spark letters.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%p": "a", "%I": "hh", "%f": "SSSSSS"}
#: Texts that stand for a missing date.
NO_DATE = ("0", "", "null", "None", "00000000")


def java_pattern(pattern: str) -> str:
    """A strftime pattern in the letters of Spark's date functions; other letters are quoted."""
    out, k = [], 0
    while k < len(pattern):
        if (two := pattern[k : k + 2]) in DIRECTIVES:
            out.append(DIRECTIVES[two])
            k += 2
        else:
            out.append(f"'{pattern[k]}'" if pattern[k].isalpha() else pattern[k])
            k += 1
    return "".join(out)


def reformatted(col: Column, source: str = "%Y%m%d", target: str = "%Y-%m-%d") -> Column:
    """A date text in another pattern; sentinels and texts that do not parse become null."""
    text = col.cast("string")
    parsed = F.try_to_timestamp(F.when(~text.isin(*NO_DATE), text), F.lit(java_pattern(source)))
    return F.date_format(parsed, java_pattern(target))


def camel(name: str) -> str:
    """snake_case to camelCase; outer underscores go."""
    first, *rest = [p for p in name.strip("_").split("_") if p] or [name]
    return first + "".join(p[:1].upper() + p[1:] for p in rest)


def pascal(name: str) -> str:
    c = camel(name)
    return c[:1].upper() + c[1:]


def as_text(col: Column, kind: T.DataType) -> Column:
    """A value as text: nested values as JSON, whole numbers of a floating type without a fraction."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (col == F.floor(col)) & (F.abs(col) < 1e15)
        return F.when(whole, col.cast("bigint").cast("string")).otherwise(col.cast("string"))
    return col.cast("string")
