"""Runs: for each entity and attribute the history as (first_seen, last_seen, valid_to, value).

Canonical form: of operations at one time the last to arrive counts; equal values next to each other are one run; a
run is valid until the next begins. Everything is windows over (key, attr), so the log is exchanged once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from .oplog import FOREVER


def _islands(ops: DataFrame, by: list[str], first: str, last: str) -> DataFrame:
    """Rows (first, last, value, _v, _seq) in order of time, with neighbours of equal ``_v`` put together."""
    order = Window.partitionBy(*by).orderBy(first)
    marked = ops.withColumn("_new", F.when(F.lag("_v").over(order) == F.col("_v"), 0).otherwise(1))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy(*by, "_island").agg(F.min(first).alias("first_seen"), F.max(last).alias("last_seen"), F.first("value").alias("value"), F.first("_v").alias("_v"))
    return grouped.drop("_island")


def canonical_runs(ops: DataFrame, keys: Sequence[str], bucket_ms: int | None = None) -> DataFrame:
    """keys, attr, first_seen, last_seen, valid_to, value, is_tombstone from PUT and TOMB operations.

    With ``bucket_ms`` the runs of each stretch of time are made first, and only these are brought together:
    an entity that holds a large part of the log is then spread over many tasks.
    """
    by = [*keys, "attr"]
    rows = ops.where(F.col("op").isin("PUT", "TOMB")).select(*by, "ts", "seq", "value", V.comparison_key(F.col("value")).alias("_v"))
    own = by if bucket_ms is None else [*by, "_bucket"]
    if bucket_ms is not None:
        rows = rows.withColumn("_bucket", F.floor(F.col("ts") / bucket_ms))
    # Of several at one time the last stays: the next row's time differs.
    arrival = Window.partitionBy(*own).orderBy("ts", "seq")
    latest = rows.withColumn("_next", F.lead("ts").over(arrival)).where("_next is null or _next <> ts").drop("_next", "seq")
    runs = _islands(latest, own, "ts", "ts")
    if bucket_ms is not None:
        runs = _islands(runs.drop("_bucket"), by, "first_seen", "last_seen")
    after = F.lead("first_seen").over(Window.partitionBy(*by).orderBy("first_seen"))
    return runs.select(*by, "first_seen", "last_seen", F.coalesce(after - 1, F.lit(FOREVER)).alias("valid_to"), "value", (F.col("value.tag") == V.TOMBSTONE).alias("is_tombstone"))


def state_changes(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every PUT and TOMB with ``changed``: whether it begins a run (false: it confirms one, or a later arrival at its time replaces it)."""
    by = [*keys, "attr"]
    rows = ops.where(F.col("op").isin("PUT", "TOMB")).withColumn("_v", V.comparison_key(F.col("value")))
    order = Window.partitionBy(*by).orderBy("ts", "seq")
    last = rows.withColumn("_last", F.coalesce(F.lead("ts").over(order) != F.col("ts"), F.lit(True)))
    before = F.last(F.when(F.col("_last"), F.col("_v")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return last.withColumn("changed", F.col("_last") & ~before.eqNullSafe(F.col("_v"))).drop("_v", "_last")


def compacted(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, range-partitioned and sorted by key, so that files prune by key."""
    return runs.repartitionByRange(*keys, "attr", "first_seen").sortWithinPartitions(*keys, "attr", "first_seen")
