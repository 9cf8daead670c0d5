"""The operation log: the one input of all writers.

Columns: ``seq`` (arrival order, unique), the key columns, ``attr``, ``op`` (PUT, TOMB, CLEAR or DROP), ``value`` and
``ts`` in milliseconds (0: timeless). An entity's DROP ends all that came before it; CLEAR takes an attribute out of
the current view until the attribute is put again, and leaves its history alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

TIMELESS = 0
FOREVER = 2**63 - 1


def op(kind: str, attr: str | Column, value: Column | None, ts: Column | int = TIMELESS) -> Column:
    """A struct (attr, op, value, ts) to be exploded or selected into a log."""
    name = F.lit(attr) if isinstance(attr, str) else attr
    none = F.lit(None).cast(V.VALUE)
    at = F.lit(ts) if isinstance(ts, int) else ts
    return F.struct(name.alias("attr"), F.lit(kind).alias("op"), (value if value is not None else none).alias("value"), at.cast("bigint").alias("ts"))


def put(attr: str | Column, value: Column, ts: Column | int = TIMELESS) -> Column:
    return op("PUT", attr, value, ts)


def tomb(attr: str | Column, ts: Column | int) -> Column:
    return op("TOMB", attr, V.tombstone(), ts)


def clear(attr: str | Column) -> Column:
    return op("CLEAR", attr, None)


def drop() -> Column:
    return op("DROP", F.lit(None).cast("string"), None)


def log(df: DataFrame, keys: Sequence[str], seq: Column, *ops: Column) -> DataFrame:
    """One row per op and input row (null ops left out); ``seq`` orders rows, and ops of a row in the order given."""
    n = len(ops)
    rows = df.select(seq.cast("bigint").alias("_s"), *keys, F.posexplode(F.array(*ops)).alias("_k", "_op")).where("_op is not null")
    return rows.select((F.col("_s") * n + F.col("_k")).alias("seq"), *keys, "_op.attr", "_op.op", "_op.value", "_op.ts")


def put_all(df: DataFrame, keys: Sequence[str], seq: Column, attributes: Column, ts: Column | int = TIMELESS) -> DataFrame:
    """Operations of a map from attribute to value; a null or empty map gives none."""
    at = F.lit(ts) if isinstance(ts, int) else ts
    rows = df.select(seq.cast("bigint").alias("seq"), *keys, at.cast("bigint").alias("ts"), F.explode(attributes).alias("attr", "value"))
    return rows.select("seq", *keys, "attr", F.lit("PUT").alias("op"), F.coalesce("value", V.null_value()).alias("value"), "ts")


def problem(keys: Sequence[str]) -> Column:
    """Why an operation cannot be taken, null if it can."""
    reasons = [
        (~F.coalesce(F.col("op").isin("PUT", "TOMB", "CLEAR", "DROP"), F.lit(False)), "unknown operation"),
        ((F.col("op") != "DROP") & F.col("attr").isNull(), "no attribute"),
        (F.col("op").isin("PUT", "TOMB") & F.coalesce(F.col("ts") < 0, F.lit(True)), "time is null or before 1970"),
        ((F.col("op") == "PUT") & (V.payload_bytes(F.col("value")) > V.MAX_PAYLOAD), "payload over 65535 bytes"),
    ]
    return F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), F.lit(text)) for test, text in reasons))


def validated(ops: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(operations that can be taken, quarantine with a ``reason``)."""
    checked = ops.withColumn("reason", problem(keys))
    good = checked.where("reason is null").drop("reason").withColumn("value", F.when(F.col("op") == "PUT", F.coalesce("value", V.null_value())).when(F.col("op") == "TOMB", V.tombstone()))
    return good, checked.where("reason is not null")


def since_drop(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Operations after their entity's last DROP, without the DROPs. Dropped entities are found by a small aggregate."""
    drops = ops.where("op = 'DROP'").groupBy(*keys).agg(F.max("seq").alias("_drop"))
    rest = ops.where("op <> 'DROP'")
    joined = rest.join(drops.select(*[F.col(k).alias(f"_d_{k}") for k in keys], "_drop"), [F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in keys], "left")
    return joined.where("_drop is null or seq > _drop").drop("_drop", *[f"_d_{k}" for k in keys])
