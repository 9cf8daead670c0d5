"""Reads over runs: latest, as-of, whole states, histories, and as-of for a batch of probes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .oplog import FOREVER


def active_at(ts: Column | int) -> Column:
    """Whether a run covers a time."""
    t = F.lit(ts) if isinstance(ts, int) else ts
    return (F.col("first_seen") <= t) & (F.col("valid_to") >= t)


def overlaps(start: Column | int, end: Column | int) -> Column:
    """Whether a run meets a closed range; a reversed range meets none."""
    a, z = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return (F.col("first_seen") <= z) & (F.col("valid_to") >= a) & (a <= z)


def get_at(runs: DataFrame, ts: int, attr: str | None = None) -> DataFrame:
    """The values at a time; tombstones are absence, stored NULLs are values. Filters reach the scan."""
    at = runs.where(active_at(ts) & ~F.col("is_tombstone"))
    return at if attr is None else at.where(F.col("attr") == attr)


def cleared(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, attr) that a CLEAR has taken out of the current view and no later PUT has brought back."""
    rows = ops.where(F.col("op").isin("PUT", "CLEAR")).groupBy(*keys, "attr").agg(F.max(F.when(F.col("op") == "CLEAR", F.col("seq"))).alias("_c"), F.max(F.when(F.col("op") == "PUT", F.col("seq"))).alias("_p"))
    return rows.where("_c is not null and (_p is null or _p < _c)").select(*keys, "attr")


def get_latest(runs: DataFrame, keys: Sequence[str], ops: DataFrame | None = None, attr: str | None = None) -> DataFrame:
    """The values that hold now: at the end of time, less what is cleared in ``ops``."""
    now = runs.where((F.col("valid_to") == FOREVER) & ~F.col("is_tombstone"))
    if attr is not None:
        now = now.where(F.col("attr") == attr)
    if ops is not None:
        gone = cleared(ops, keys).select(*[F.col(c).alias(f"_c_{c}") for c in (*keys, "attr")])
        now = now.join(gone, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in (*keys, "attr")], "left_anti")
    return now


def state_map(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, state): a map from attribute to value. An entity has as many entries as attributes."""
    return values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("attr", "value"))).alias("state"))


def get_all(runs: DataFrame, keys: Sequence[str], ops: DataFrame | None = None) -> DataFrame:
    return state_map(get_latest(runs, keys, ops), keys)


def get_all_at(runs: DataFrame, keys: Sequence[str], ts: int) -> DataFrame:
    return state_map(get_at(runs, ts), keys)


def history(runs: DataFrame, keys: Sequence[str], attr: str | None = None, ordered: bool = True) -> DataFrame:
    """All runs, tombstones included and marked, in ascending order."""
    rows = runs if attr is None else runs.where(F.col("attr") == attr)
    return rows.orderBy(*keys, "attr", "first_seen") if ordered else rows


def history_range(runs: DataFrame, start: int, end: int, attr: str | None = None) -> DataFrame:
    """Runs that meet [start, end]."""
    rows = runs.where(overlaps(start, end))
    return rows if attr is None else rows.where(F.col("attr") == attr)


def neighbours(runs: DataFrame, keys: Sequence[str], ts: int) -> DataFrame:
    """Per entity and attribute the starts of the runs at or before, and at or after a time, and of the first and last."""
    start = F.col("first_seen")
    return runs.groupBy(*keys, "attr").agg(
        F.max(F.when(start <= ts, start)).alias("predecessor"),
        F.min(F.when(start >= ts, start)).alias("successor"),
        F.min(start).alias("leftmost"),
        F.max(start).alias("rightmost"),
    )


def asof_batch(runs: DataFrame, probes: DataFrame, keys: Sequence[str], ts_col: str = "ts") -> DataFrame:
    """Each probe (keys, attr, ts, ...) with the value that holds at its time, null if none.

    Runs and probes are united and sorted once per (key, attr); the last run at or before a probe is carried
    forward. Time is linear in both, however many runs a key has.
    """
    by = [*keys, "attr"]
    rest = [c for c in probes.columns if c not in by]
    left = runs.select(*by, F.col("first_seen").alias("_t"), F.lit(0).alias("_side"), F.struct("value", "valid_to", "is_tombstone").alias("_run"), F.lit(None).cast(probes.select(F.struct(*rest)).schema[0].dataType).alias("_probe"))
    right = probes.select(*by, F.col(ts_col).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema["_run"].dataType).alias("_run"), F.struct(*rest).alias("_probe"))
    order = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = left.unionByName(right).withColumn("_run", F.last("_run", ignorenulls=True).over(order)).where("_side = 1")
    holds = (F.col("_run.valid_to") >= F.col("_t")) & ~F.col("_run.is_tombstone")
    return carried.select(*by, "_probe.*", F.when(holds, F.col("_run.value")).alias("value"))
