"""Any value as one that JSON can hold: a compiler from a type to Columns, through structs, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def iso(c: Column, zoned: bool) -> Column:
    """An ISO time with six digits of a second where it has a fraction; with the session's offset if it is zoned."""
    zone = "xxx" if zoned else ""
    whole, parts = (F.date_format(c, f"yyyy-MM-dd'T'HH:mm:ss{x}{zone}") for x in ("", ".SSSSSS"))
    return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(parts)


def safe(c: Column, kind: T.DataType) -> Column:
    """c of the type ``kind`` as JSON-safe: NaN and infinities are null, times are ISO texts, decimals and intervals texts, bytes
    UTF-8 (bad ones replaced), map keys texts; the rest, and what is safe already, stays."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso(c, isinstance(kind, T.TimestampType))
    if isinstance(kind, T.BinaryType):
        return F.make_valid_utf8(c.cast("string"))
    if isinstance(kind, T.StructType):
        made = F.struct(*(safe(c[f.name], f.dataType).alias(f.name) for f in kind.fields))
        return F.when(c.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.transform_keys(c, lambda k, _: safe(k, kind.keyType).cast("string")), lambda _, v: safe(v, kind.valueType))
    if isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType, T.NullType)) or kind.typeName() in ("variant", "char", "varchar"):
        return c
    return c.cast("string")  # decimals, intervals


def safe_columns(df: DataFrame) -> DataFrame:
    """df with all its columns made safe, under their names."""
    return df.select(*(safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One column: each row of df as a JSON object, nulls written out."""
    made = safe_columns(df)
    return made.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in made.columns)), {"ignoreNullFields": "false"}).alias(name))
