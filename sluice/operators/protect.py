"""Encryption of columns, key rotation and redaction of sensitive fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of names, in any case, that mark a field as sensitive.
SENSITIVE = ("password", "secret", "token", "key", "credential", "auth", "private", "passwd", "pwd")
REDACTED = "***REDACTED***"


def _key(key: bytes | str) -> Column:
    data = key.encode() if isinstance(key, str) else key
    if len(data) != 32:
        raise ValueError("the key must have 32 bytes")
    return F.lit(data)


def encrypted(col: Column, key: bytes | str) -> Column:
    """AES-256-GCM with a random nonce, as url-safe base64 of nonce, ciphertext and tag; null stays null."""
    return F.translate(F.base64(F.aes_encrypt(col.cast("string").cast("binary"), _key(key), F.lit("GCM"))), "+/", "-_")


def decrypted(col: Column, key: bytes | str) -> Column:
    """The text of an encrypted value, null if the key is wrong or the value damaged."""
    return F.try_aes_decrypt(F.try_to_binary(F.translate(col, "-_", "+/"), F.lit("base64")), _key(key), F.lit("GCM")).cast("string")


def encrypt_fields(df: DataFrame, fields: list[str], key: bytes | str) -> DataFrame:
    return df.withColumns({f: encrypted(F.col(f), key) for f in fields if f in df.columns})


def decrypt_fields(df: DataFrame, fields: list[str], key: bytes | str, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Decrypted rows; and the rows in which a value did not decrypt, as they were, with the reason in _error."""
    fields = [f for f in fields if f in df.columns]
    if fields:
        # As a generator's output the texts are computed once: filters and selections above do not take a copy of the cipher.
        df = df.select("*", F.explode(F.array(F.struct(*[decrypted(F.col(f), key).alias(f"_{k}") for k, f in enumerate(fields)]))).alias("_opened"))
    opened = {f: F.col("_opened")[f"_{k}"] for k, f in enumerate(fields)}
    errors = [F.when(F.col(f).isNotNull() & text.isNull(), F.lit(f"{f}: cannot decrypt")) for f, text in opened.items()]
    marked = keep(df.withColumn("_error", F.concat_ws("; ", *errors)))
    good = marked.filter("_error = ''").withColumns(opened).drop("_error", "_opened")
    return good, marked.filter("_error <> ''").drop("_opened")


def seal(col: Column, keys: dict[int, bytes | str], version: int, tenant: Column) -> Column:
    """A versioned token enc:v<n>:<base64> that is bound to its tenant."""
    data = F.aes_encrypt(col.cast("string").cast("binary"), _key(keys[version]), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), tenant.cast("binary"))
    return F.concat(F.lit(f"enc:v{version}:"), F.translate(F.base64(data), "+/", "-_"))


def unseal(col: Column, keys: dict[int, bytes | str], tenant: Column) -> Column:
    """The text of a token, by the key of its version; null if it does not open."""
    parts = F.split(col, ":")
    data = F.try_to_binary(F.translate(F.try_element_at(parts, F.lit(3)), "-_", "+/"), F.lit("base64"))
    by_version = [F.when(F.try_element_at(parts, F.lit(2)) == f"v{v}", F.try_aes_decrypt(data, _key(k), F.lit("GCM"), F.lit("DEFAULT"), tenant.cast("binary"))) for v, k in keys.items()]
    return F.coalesce(*by_version).cast("string")


def rotate_keys(df: DataFrame, column: str, keys: dict[int, bytes | str], tenant: Column, to: int | None = None) -> DataFrame:
    """Tokens of older versions sealed anew with the newest key; others stay."""
    to = to or max(keys)
    old = ~F.col(column).startswith(f"enc:v{to}:")
    return df.withColumn(column, F.when(old, seal(unseal(F.col(column), keys, tenant), keys, to, tenant)).otherwise(F.col(column)))


def redacted(df: DataFrame, patterns: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """Fields, also nested ones, whose name contains a pattern have their value replaced by a fixed text."""

    def walk(col: Column, kind: T.DataType, name: str) -> Column:
        if any(p in name.lower() for p in patterns):
            return F.lit(REDACTED)
        if isinstance(kind, T.StructType):
            return F.when(col.isNotNull(), F.struct(*[walk(col[f.name], f.dataType, f.name).alias(f.name) for f in kind]))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(col, lambda x: walk(x, kind.elementType, ""))
        return col

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema])
