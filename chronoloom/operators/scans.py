"""Scans by key: full, by leading fields, and by leading bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import KeyLayout


class Query:
    """Equality on leading key fields. A field after an unset one does not narrow; strings that were never interned cannot match."""

    def __init__(self, layout: KeyLayout) -> None:
        self.layout = layout
        self.clear()

    def clear(self) -> Query:
        self.given: dict[str, object] = {}
        return self

    def set(self, field: str | int, value: object) -> Query:
        self.given[self.layout.field(field).name] = value
        return self

    @property
    def leading(self) -> list[str]:
        out = []
        for f in self.layout.fields:
            if f.name not in self.given:
                break
            out.append(f.name)
        return out

    @property
    def prefix_length(self) -> int:
        return sum(self.layout.field(n).width for n in self.leading)

    def satisfiable(self, up_to: str | int | None = None) -> bool:
        """Whether all fields up to the given one are set."""
        if up_to is None:
            return True
        names = self.layout.names
        return len(self.leading) > names.index(self.layout.field(up_to).name)


def entities(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of entities with a PUT or TOMB; give operations since the last DROP."""
    return ops.where(F.col("op").isin("PUT", "TOMB")).select(*keys).distinct()


def scan_all(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    return rows.orderBy(*order)


def scan(rows: DataFrame, query: Query, up_to: str | int | None = None) -> DataFrame:
    """Rows whose leading fields equal the query's; none if a field up to ``up_to`` is not set. Reads never intern."""
    if not query.satisfiable(up_to):
        return rows.limit(0)
    names = query.leading if up_to is None else query.layout.names[: query.layout.names.index(query.layout.field(up_to).name) + 1]
    for n in names:
        rows = rows.where(F.col(n).eqNullSafe(F.lit(query.given[n])))
    return rows


def scan_bytes(rows: DataFrame, key_col: str, prefix: bytes) -> DataFrame:
    """Rows whose encoded key begins with ``prefix``, which may end inside a field."""
    return rows.where(F.startswith(F.col(key_col), F.lit(prefix)))


def size(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: n_entities and is_empty."""
    return entities(ops, keys).agg(F.count(F.lit(1)).alias("n_entities")).withColumn("is_empty", F.col("n_entities") == 0)


def first_and_count(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in order, each with ``n_matches``, the number of all rows. Tasks keep ``n`` rows each."""
    first = rows.orderBy(*order).limit(n)
    return first.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n_matches"))), F.lit(True))  # one row
