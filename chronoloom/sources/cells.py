"""Lossless ingest of wide tables: every non-null cell becomes one operation, and comes back as it was."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.keys import wide_literal


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file, or all ``*.parquet`` files below a folder."""
    return spark.read.parquet(path)


def unsigned_id(col: Column) -> Column:
    """A positive unsigned 64-bit id from a number or text; null where it is none."""
    text = F.trim(col.cast("string"))
    wide = F.when(text.rlike("^[0-9]{1,20}$"), text.cast("decimal(20,0)"))
    return F.when((wide > 0) & (wide <= wide_literal(2**64 - 1)), wide)


def event_time(col: Column, kind: T.DataType) -> Column:
    """Milliseconds of a timestamp; a missing one is timeless (0)."""
    return F.coalesce(V.millis(col, kind), F.lit(0)).cast("bigint")


def unpivot(df: DataFrame, keys: Sequence[str], attributes: Sequence[str], seq: Column, ts: Column) -> DataFrame:
    """Operations (seq, keys, attr, op, value, ts): a PUT for each non-null cell of ``attributes``, in one pass over the rows."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(*(F.when(F.col(a).isNotNull(), F.struct(F.lit(a).alias("attr"), V.of_type(F.col(a), kinds[a]).alias("value"))) for a in attributes))
    rows = df.select(seq.cast("bigint").alias("seq"), *keys, ts.cast("bigint").alias("ts"), F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("c"))
    return rows.select("seq", *keys, "c.attr", F.lit("PUT").alias("op"), "c.value", "ts")


def json_array(col: Column) -> Column:
    """An array of strings as a JSON array; null elements stay, empty is not null."""
    return F.to_json(col)


def from_json_array(col: Column) -> Column:
    return F.from_json(col, "array<string>")


def cell(value: Column, kind: T.DataType) -> Column:
    """The original cell of a value, by its column's type."""
    if isinstance(kind, T.BooleanType):
        return value["i"] != 0
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return value["i"].cast(kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return value["f"].cast(kind)
    if isinstance(kind, T.StringType):
        return value["s"]
    if isinstance(kind, T.BinaryType):
        return value["b"]
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_add("MILLISECOND", value["i"], F.lit("1970-01-01").cast("timestamp_ntz"))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_millis(value["i"])
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(value["i"].cast("int"))
    if isinstance(kind, T.DecimalType):
        return value["s"].cast(kind)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.from_json(value["s"], kind)
    raise TypeError(f"no cell for {kind.simpleString()}")


def rebuilt(values: DataFrame, keys: Sequence[str], schema: T.StructType, attributes: Sequence[str]) -> DataFrame:
    """The wide rows again, from (keys, attr, value): one aggregate with a column for each attribute."""
    kinds = {f.name: f.dataType for f in schema.fields}
    picked = (F.first(F.when(F.col("attr") == a, F.col("value")), ignorenulls=True).alias(a) for a in attributes)
    wide = values.groupBy(*keys).agg(*picked)
    return wide.select(*keys, *(cell(F.col(a), kinds[a]).alias(a) for a in attributes))


def mismatches(original: DataFrame, again: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """One row: n_rows, n_cells, n_mismatches of a full comparison by key. Maps compare as JSON; floats by value."""
    a = original.select(*keys, *(F.col(c).alias(f"_a_{c}") for c in attributes), F.lit(True).alias("_here"))
    b = again.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in attributes))
    both = a.join(b, list(keys), "full")
    text = lambda c, col: F.to_json(F.array(col)) if isinstance(original.schema[c].dataType, T.MapType) else col
    wrong = sum((F.when(text(c, F.col(f"_a_{c}")).eqNullSafe(text(c, F.col(f"_b_{c}"))), 0).otherwise(1) for c in attributes), F.lit(0))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) * len(attributes)).alias("n_cells"), F.coalesce(F.sum(wrong), F.lit(0)).alias("n_mismatches"))


def leaves(schema: T.StructType) -> list[tuple[str, str, bool]]:
    """(name, type, repeated) of each column; an array stands for its elements."""
    return [(f.name, (f.dataType.elementType if (many := isinstance(f.dataType, T.ArrayType)) else f.dataType).simpleString(), many) for f in schema.fields]


def schema_text(schema: T.StructType) -> str:
    """The sidecar's text."""
    return json.dumps({"schema": json.loads(schema.json()), "leaves": leaves(schema)})


def schema_from_text(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text)["schema"])
