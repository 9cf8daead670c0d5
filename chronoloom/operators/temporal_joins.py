"""Extensions over runs, which Spark gives for little: interval joins of attributes, time-weighted sums, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .reads import overlaps


def scan_overlap(runs: DataFrame, start: int, end: int) -> DataFrame:
    """Runs of all entities that meet [start, end]."""
    return runs.where(overlaps(start, end))


def interval_join(runs: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """keys, overlap_from, overlap_to, left_value, right_value: where runs of two attributes of one entity hold at once.

    An attribute's runs do not overlap, so where two of them begin to hold together one of them begins: at each start the last
    run of either attribute is looked at. One window over the entity, linear in its runs, however many pairs of them there are.
    """
    rows = runs.where(F.col("attr").isin(left, right) & ~F.col("is_tombstone")).select(*keys, "attr", F.col("first_seen").alias("_t"), F.struct("first_seen", "valid_to", "value").alias("_run"))
    upto = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    last = lambda attr: F.last(F.when(F.col("attr") == attr, F.col("_run")), ignorenulls=True).over(upto)
    both = rows.withColumns({"_l": last(left), "_r": last(right)})
    # Where both begin at once, the left one's row stands for them.
    holds = (F.col("_l.valid_to") >= F.col("_t")) & (F.col("_r.valid_to") >= F.col("_t")) & ((F.col("attr") == left) | (F.col("_l.first_seen") != F.col("_t")))
    return both.where(holds).select(*keys, F.col("_t").alias("overlap_from"), F.least("_l.valid_to", "_r.valid_to").alias("overlap_to"), F.col("_l.value").alias("left_value"), F.col("_r.value").alias("right_value"))


def time_weighted(runs: DataFrame, keys: Sequence[str], start: int, end: int) -> DataFrame:
    """keys, attr, value, duration_ms: how long each value held within [start, end)."""
    inside = runs.where(overlaps(start, end - 1) & ~F.col("is_tombstone"))
    held = F.least(F.col("valid_to"), F.lit(end - 1)) - F.greatest(F.col("first_seen"), F.lit(start)) + 1
    return inside.groupBy(*keys, "attr", "value").agg(F.sum(held).alias("duration_ms"))


def retained(runs: DataFrame, horizon: int) -> DataFrame:
    """Runs that still hold at or after the horizon: what stays when older history is archived."""
    return runs.where(F.col("valid_to") >= horizon)
