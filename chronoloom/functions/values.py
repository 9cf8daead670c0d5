"""Tagged values: every cell carries its own type.

A value is ``struct<tag, i, f, s, b>``; the tag says which payload counts. Equality, which decides whether runs
coalesce, is equality of tag and bits: ``Int(1)`` differs from ``Long(1)`` and ``0.0`` from ``-0.0``, so values are compared by
``comparison_key``, which is never null. All NaNs are one value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type tags; fixed values.
TOMBSTONE, NULL, INT32, INT64, FLOAT32, FLOAT64, BOOL, STRING, JSON, BYTES = -1, 0, 1, 2, 3, 4, 5, 6, 7, 8
NAMES = {NULL: "NULL", INT32: "INT32", INT64: "INT64", FLOAT32: "FLOAT32", FLOAT64: "FLOAT64", BOOL: "BOOL", STRING: "STRING", JSON: "JSON", BYTES: "BYTES"}
#: Bytes of payload that a value may have.
MAX_PAYLOAD = 65_535

VALUE = T.StructType([T.StructField("tag", T.ByteType()), T.StructField("i", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("b", T.BinaryType())])


def _value(tag: int | Column, i=None, f=None, s=None, b=None) -> Column:
    cell = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    return F.struct((F.lit(tag) if isinstance(tag, int) else tag).cast("tinyint").alias("tag"), cell(i, "bigint").alias("i"), cell(f, "double").alias("f"), cell(s, "string").alias("s"), cell(b, "binary").alias("b"))


def _or_null(col: Column, value: Column) -> Column:
    """A null input is the stored NULL, which is not absence."""
    return F.when(col.isNull(), _value(NULL)).otherwise(value)


def null_value() -> Column:
    return _value(NULL)


def tombstone() -> Column:
    return _value(TOMBSTONE)


def int32(col: Column) -> Column:
    return _or_null(col, _value(INT32, i=col))


def int64(col: Column) -> Column:
    return _or_null(col, _value(INT64, i=col))


def float32(col: Column) -> Column:
    return _or_null(col, _value(FLOAT32, f=col.cast("float")))


def float64(col: Column) -> Column:
    return _or_null(col, _value(FLOAT64, f=col))


def boolean(col: Column) -> Column:
    return _or_null(col, _value(BOOL, i=col.cast("int")))


def string(col: Column) -> Column:
    return _or_null(col, _value(STRING, s=col))


def json(col: Column) -> Column:
    """JSON text; it is tagged, not parsed."""
    return _or_null(col, _value(JSON, s=col))


def binary(col: Column) -> Column:
    return _or_null(col, _value(BYTES, b=col))


def millis(col: Column, kind: T.DataType) -> Column:
    """Milliseconds since 1970, rounded down; times without a zone are taken as they are, whatever the session's zone."""
    if isinstance(kind, T.TimestampNTZType):
        return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col) / 1000).cast("bigint")
    return F.unix_millis(col.cast("timestamp"))


def of_type(col: Column, kind: T.DataType) -> Column:
    """The value for a Parquet column's type; decimals become text, arrays, structs and maps JSON, null elements kept."""
    if isinstance(kind, T.BooleanType):
        return boolean(col)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return int32(col)
    if isinstance(kind, T.LongType):
        return int64(col)
    if isinstance(kind, T.FloatType):
        return float32(col)
    if isinstance(kind, T.DoubleType):
        return float64(col)
    if isinstance(kind, T.StringType):
        return string(col)
    if isinstance(kind, T.BinaryType):
        return binary(col)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return int64(millis(col, kind))
    if isinstance(kind, T.DateType):
        return int32(F.unix_date(col))
    if isinstance(kind, T.DecimalType):
        return string(col.cast("string"))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return json(F.to_json(col, {"ignoreNullFields": "false"}))
    raise TypeError(f"no value type for {kind.simpleString()}")


def comparison_key(value: Column) -> Column:
    return F.concat_ws(":", value["tag"].cast("string"), value["i"].cast("string"), value["f"].cast("string"), value["s"], F.hex(value["b"]))


def payload_bytes(value: Column) -> Column:
    fixed = F.when(value["tag"].isin(INT32, FLOAT32), 4).when(value["tag"].isin(INT64, FLOAT64), 8).when(value["tag"] == BOOL, 1).otherwise(0)
    return F.coalesce(F.octet_length(value["s"]), F.octet_length(value["b"]), fixed)


def _typed(value: Column, tags: tuple[int, ...], payload: Column, what: str) -> Column:
    wrong = F.raise_error(F.concat(F.lit(f"not {what}: tag "), value["tag"].cast("string")))
    return F.when(value.isNull(), F.lit(None)).when(value["tag"].isin(*tags), payload).otherwise(wrong)


def as_int(value: Column) -> Column:
    return _typed(value, (INT32,), value["i"].cast("int"), "an INT32")


def as_long(value: Column) -> Column:
    return _typed(value, (INT32, INT64), value["i"], "an integer")


def as_float32(value: Column) -> Column:
    return _typed(value, (FLOAT32,), value["f"].cast("float"), "a FLOAT32")


def as_float64(value: Column) -> Column:
    return _typed(value, (FLOAT32, FLOAT64), value["f"], "a float")


def as_bool(value: Column) -> Column:
    return _typed(value, (BOOL,), value["i"] != 0, "a BOOL")


def as_string(value: Column) -> Column:
    return _typed(value, (STRING, JSON), value["s"], "a string")


def as_bytes(value: Column) -> Column:
    return _typed(value, (BYTES,), value["b"], "bytes")


def is_null(value: Column) -> Column:
    return value["tag"] == NULL
