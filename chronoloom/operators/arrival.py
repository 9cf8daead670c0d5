"""The arrival-order fold: runs exactly as a writer that sees operations one by one would leave them.

A late operation splits the run that it falls into, so the result depends on the order of arrival and has no
window form. It is folded per (key, attr) in Python; use the canonical form where operations arrive in order of time.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from .oplog import FOREVER

Run = list  # [first_seen, last_seen, valid_to, identity, place of the value]


def fold(ops: Iterable[tuple[int, object, object]], runs: list[Run] | None = None) -> list[Run]:
    """Runs after operations (ts, identity, payload) in order of arrival; ``identity`` decides equality."""
    runs = runs if runs is not None else []
    starts = [r[0] for r in runs]

    def insert(k: int, run: Run) -> None:
        runs.insert(k, run)
        starts.insert(k, run[0])

    for ts, same, payload in ops:
        k = bisect_right(starts, ts) - 1
        before = runs[k] if k >= 0 else None
        if before is not None and before[3] == same:  # confirmed
            before[1] = max(before[1], ts)
            continue
        if before is not None and ts <= before[1]:  # inside what was seen: split
            first, last, until, old, old_payload = before
            if first == ts:
                del runs[k], starts[k]
            else:
                before[2] = ts - 1
                k += 1
            resumes = ts < until and last > ts
            insert(k, [ts, ts, ts if resumes else until, same, payload])
            if resumes:
                insert(k + 1, [ts + 1, last, until, old, old_payload])
            continue
        n = bisect_left(starts, ts)
        after = runs[n] if n < len(runs) else None
        if after is not None and after[3] == same:  # seen earlier than known
            after[0] = starts[n] = ts
            continue
        insert(n, [ts, ts, after[0] - 1 if after is not None else FOREVER, same, payload])
        if before is not None:
            before[2] = ts - 1
    return runs


def arrival_runs(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, attr, first_seen, last_seen, valid_to (published: until the next run), raw_valid_to (as folded), value, is_tombstone.

    Rows are dealt by (key, attr) and sorted by arrival; a task folds one group after the other and holds one at a time.
    """
    by = [*keys, "attr"]
    cells = ["tag", "i", "f", "s", "b"]
    name = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("_k")
    rows = ops.where(F.col("op").isin("PUT", "TOMB")).select(name, *by, "seq", "ts", "value.*", V.comparison_key(F.col("value")).alias("_v"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "first_seen bigint, last_seen bigint, valid_to bigint, raw_valid_to bigint", *(f"{c} {kinds[c]}" for c in cells)])

    def folded(table: pa.Table) -> pa.Table:
        group, ts, same = (table.column(c).to_pylist() for c in ("_k", "ts", "_v"))
        place, spans = [], ([], [], [], [])
        at = 0
        for _, members in groupby(group):
            n = sum(1 for _ in members)
            runs = fold(zip(ts[at : at + n], same[at : at + n], range(at, at + n), strict=True))
            ends = [*(r[0] - 1 for r in runs[1:]), FOREVER]
            place += [r[4] for r in runs]
            for column, values in zip(spans, ([r[0] for r in runs], [r[1] for r in runs], ends, [r[2] for r in runs]), strict=True):
                column += values
            at += n
        picked = table.take(pa.array(place, pa.int64()))
        return pa.table([*(picked.column(c) for c in by), *(pa.array(x, pa.int64()) for x in spans), *(picked.column(c) for c in cells)], names=[*by, "first_seen", "last_seen", "valid_to", "raw_valid_to", *cells])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0)
            last = names[batch.num_rows - 1]
            begin = batch.num_rows - 1  # where the last group of the batch begins
            while begin and names[begin - 1] == last:
                begin -= 1
            if begin or (rest and rest[-1].column(0)[0] != last):
                yield from folded(pa.Table.from_batches([*rest, batch.slice(0, begin)])).to_batches()
                rest = []
            rest.append(batch.slice(begin))
        if rest:
            yield from folded(pa.Table.from_batches(rest)).to_batches()

    out = rows.repartition("_k").sortWithinPartitions("_k", "seq").mapInArrow(run, schema)
    return out.select(*by, "first_seen", "last_seen", "valid_to", "raw_valid_to", F.struct(*cells).alias("value"), (F.col("tag") == V.TOMBSTONE).alias("is_tombstone"))


def replay(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Operations that rebuild a history from its runs: one at first_seen and, if later, one at last_seen."""
    at = F.when(F.col("last_seen") > F.col("first_seen"), F.array("first_seen", "last_seen")).otherwise(F.array("first_seen"))
    rows = runs.select(*keys, "attr", "value", F.explode(at).alias("ts"), "first_seen")
    kind = F.when(F.col("value.tag") == V.TOMBSTONE, "TOMB").otherwise("PUT")
    # Runs are replayed in order of first_seen; one run's two operations in order of time.
    return rows.select(F.struct("first_seen", "ts").alias("seq"), *keys, "attr", kind.alias("op"), "value", "ts")


def copy_replay(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The runs of a store that is filled by replaying another's history; equal neighbours coalesce in this."""
    ops = replay(runs, keys)
    by = [*keys, "attr"]
    flat = ops.withColumn("_o", F.col("seq")).drop("seq")
    numbered = flat.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy("_o")).cast("bigint")).drop("_o")
    return arrival_runs(numbered, keys)
