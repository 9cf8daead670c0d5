"""Streaming writers.

``stream_to_store`` appends micro-batches to a store, so history and late data are as in batch: lateness is unlimited,
because runs are derived from the whole log. ``stream_changes`` keeps each (key, attr)'s current run as state and
emits a run when it ends; operations older than the correction horizon go to the quarantine instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import values as V
from ..sources.store import Store


def stream_to_store(ops: DataFrame, store: Store, checkpoint: str):
    """A started query that commits each micro-batch of operations (as in the log) to ``store``."""

    def commit(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.append(batch)

    return ops.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_late(ops: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """(operations at or after the correction horizon or timeless, quarantine)."""
    late = (F.col("ts") < horizon) & (F.col("ts") != 0)
    return ops.where(~late), ops.where(late).withColumn("reason", F.lit("before the correction horizon"))


def stream_changes(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, attr, first_seen, last_seen, cmp: runs that have ended, in streams where each key's operations come in order of time.

    The state of a (key, attr) is its open run, so memory is that of the keys, not of the history.
    """
    by = [*keys, "attr"]
    rows = ops.where(F.col("op").isin("PUT", "TOMB")).select(*by, "ts", "seq", V.comparison_key(F.col("value")).alias("cmp"))
    kinds = dict(rows.dtypes)
    out = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "first_seen bigint, last_seen bigint, cmp string"])

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, now = state.get if state.exists else (None, None, None)
        done = []
        frame = pd.concat(list(parts)).sort_values(["ts", "seq"])
        for ts, cmp in zip(frame["ts"].tolist(), frame["cmp"].tolist(), strict=True):
            if now is not None and cmp == now:
                last = max(last, ts)
            else:
                if now is not None and ts > first:
                    done.append((*key, first, last, now))
                first, last, now = ts, ts, cmp
        state.update((first, last, now))
        yield pd.DataFrame(done, columns=[*by, "first_seen", "last_seen", "cmp"])

    return rows.groupBy(*by).applyInPandasWithState(run, out, "first_seen bigint, last_seen bigint, cmp string", "append", GroupStateTimeout.NoTimeout)


def windowed_changes(ops: DataFrame, keys: Sequence[str], every: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Operations per window and attribute, with a watermark that lets late ones in for ``delay``."""
    timed = ops.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", every), "attr").agg(F.count(F.lit(1)).alias("n_ops"))
