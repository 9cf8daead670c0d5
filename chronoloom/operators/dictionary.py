"""Dictionaries: strings to integer codes in order of first appearance, from 1; code 0 stands for null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import MAX_CODE, MAX_ENCODED, encoded_length

#: Rows of a dictionary up to which it is broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 100_000


def intern(values: DataFrame, value_col: str, seq: Column, known: DataFrame | None = None, kind: str = "dict32") -> DataFrame:
    """(value, code): ``known`` with the new values added in order of their least ``seq``.

    New values are found by an aggregate and numbered by a range-partitioned sort: places within partitions
    plus the partitions' offsets, which are all that comes to the driver.
    """
    new = values.where(F.col(value_col).isNotNull()).groupBy(F.col(value_col).alias("value")).agg(F.min(seq).alias("_seq"))
    base = 0
    if known is not None:
        new = new.join(known.select("value"), "value", "left_anti")
        base = known.agg(F.max("code")).first()[0] or 0
    new = new.withColumn("value", F.when(encoded_length(F.col("value")) <= MAX_ENCODED, F.col("value")).otherwise(F.raise_error(F.lit(f"a dictionary string takes over {MAX_ENCODED} bytes"))))
    ordered = new.repartitionByRange("_seq", "value").sortWithinPartitions("_seq", "value").withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).persist()
    counts = sorted((r._p, r["count"]) for r in ordered.groupBy("_p").count().collect())
    offsets, total = [], base
    for p, n in counts:
        offsets += [F.lit(p), F.lit(total)]
        total += n
    if total > MAX_CODE[kind]:
        raise OverflowError(f"{total} codes do not fit into {kind}")
    code = (F.create_map(*offsets)[F.col("_p")] + F.col("_k") + 1 if offsets else F.lit(0)).cast("int")
    out = ordered.select("value", code.alias("code"))
    return out if known is None else known.select("value", "code").unionByName(out)


def _small(dictionary: DataFrame) -> bool:
    return dictionary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def resolve(rows: DataFrame, value_col: str, dictionary: DataFrame, code_col: str = "code") -> DataFrame:
    """``rows`` with their codes: 0 for null, -1 for strings that were never interned. Nothing is interned."""
    d = dictionary.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    if _small(dictionary):
        d = F.broadcast(d)
    joined = rows.join(d, rows[value_col] == F.col("_value"), "left")
    return joined.withColumn(code_col, F.when(F.col(value_col).isNull(), 0).otherwise(F.coalesce("_code", F.lit(-1))).cast("int")).drop("_value", "_code")


def reverse(rows: DataFrame, code_col: str, dictionary: DataFrame, value_col: str = "value") -> DataFrame:
    """``rows`` with the strings of their codes, null for unknown ones."""
    d = dictionary.select(F.col("value").alias(value_col), F.col("code").alias("_code"))
    if _small(dictionary):
        d = F.broadcast(d)
    return rows.join(d, rows[code_col] == F.col("_code"), "left").drop("_code")


def stats(dictionary: DataFrame) -> DataFrame:
    """One row: size and next_code."""
    return dictionary.agg(F.count(F.lit(1)).alias("size"), (F.coalesce(F.max("code"), F.lit(0)) + 1).alias("next_code"))


def copied(source: DataFrame, target: DataFrame, source_kind: str, target_kind: str) -> DataFrame:
    """A copy of ``source`` for an empty target of the same kind."""
    if source_kind != target_kind:
        raise ValueError("dictionaries of different kinds")
    if not target.isEmpty():
        raise ValueError("the target dictionary is not empty")
    return source


def attributes(ops: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(value, code) of the attributes' names, in order of the first operation that names one."""
    return intern(ops, "attr", F.col("seq"), known)
