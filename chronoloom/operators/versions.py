"""Versions: an entity's whole state over time, derived from its runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from .oplog import FOREVER


def versions_exploded(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, first_seen, valid_to, attr, value: a row for each attribute that holds in a version.

    Change points are the starts of any attribute's runs. Each attribute's last run is carried over all change
    points of its entity in one window, so work is in proportion to the result, which has a row for each entity, change
    point and attribute.
    """
    points = runs.select(*keys, F.col("first_seen").alias("_t")).distinct()
    points = points.withColumn("_until", F.coalesce(F.lead("_t").over(Window.partitionBy(*keys).orderBy("_t")) - 1, F.lit(FOREVER)))
    grid = points.join(runs.select(*keys, "attr").distinct(), list(keys))
    starts = runs.select(*keys, "attr", F.col("first_seen").alias("_t"), F.struct("value", "is_tombstone").alias("_run"))
    order = Window.partitionBy(*keys, "attr").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    held = grid.join(starts, [*keys, "attr", "_t"], "left").withColumn("_run", F.last("_run", ignorenulls=True).over(order))
    return held.where("not _run.is_tombstone").select(*keys, F.col("_t").alias("first_seen"), F.col("_until").alias("valid_to"), "attr", F.col("_run.value").alias("value"))


def versions(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, first_seen, valid_to, state: a map for each stretch of time in which nothing changes; empty states are left out."""
    parts = versions_exploded(runs, keys).groupBy(*keys, "first_seen", "valid_to").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attr", "value")))).alias("state"))
    order = Window.partitionBy(*keys).orderBy("first_seen")
    # An array of (attribute, comparison key), so that no text in a value can pass for another state.
    print_of = F.transform(F.map_entries("state"), lambda e: F.struct(e["key"].alias("attr"), V.comparison_key(e["value"]).alias("value")))
    marked = parts.withColumn("_p", print_of).withColumn("_new", F.when((F.lag("_p").over(order) == F.col("_p")) & (F.lag("valid_to").over(order) == F.col("first_seen") - 1), 0).otherwise(1))
    numbered = marked.withColumn("_island", F.sum("_new").over(order))
    return numbered.groupBy(*keys, "_island").agg(F.min("first_seen").alias("first_seen"), F.max("valid_to").alias("valid_to"), F.first("state").alias("state")).drop("_island")
