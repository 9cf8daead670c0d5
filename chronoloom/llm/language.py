"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of up to four bytes is counted and then frozen. A byte costs the code
length that PPM's method C gives: in the longest known context -log2(c / (n + d)), or else an escape,
-log2(d / (n + d)), and on to the next shorter one; at the end every byte costs eight bits. The language in
which a text is shortest is predicted. Sums run over all bytes of the text, ASCII letters folded.

Trees come from a bounded sample of labelled rows: of each language the first documents in the order of a hash of id and
text, whole, as long as they are ``SAMPLE_DOCS`` and ``SAMPLE_BYTES`` at most, one at least. Prediction reads every text whole.

Nulls and ties: a text that is null or has no letter is ``und`` with score 0; equal code lengths go to the
first language by name. Rows with a null lang are not learnt from. Without any labelled row all are ``und``.
Rows with a null id are dealt by their text. A very long text is worked on part by part. Other columns than the named ones
are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, buffers, chunks

ORDER = 4
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 6_000_000
#: The score is the posterior after this many bytes at the text's average code length (or after all, if fewer).
EVIDENCE = 40
#: Distinct byte runs whose costs a worker remembers.
REMEMBERED = 1_500_000
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the four before it, packed into an integer; line feeds stand before a text's start."""
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(data) + ORDER * n, 10, np.uint8)
    at = np.arange(len(data)) + ORDER * (rows + 1)
    padded[at] = _FOLD[data]
    out = padded[at].astype(np.int64)
    for k in range(1, ORDER + 1):
        out |= padded[at - k].astype(np.int64) << (8 * k)
    return out


class Tree:
    """A frozen context tree: sorted keys per order with their costs in bits."""

    def __init__(self, runs: np.ndarray) -> None:
        """``runs``: distinct values of ``grams`` with counts, as two rows."""
        keys, counts = runs
        self.levels = []
        for k in range(ORDER + 1):
            own, at = np.unique(keys & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            c = np.bincount(at, counts)
            context, where = np.unique(own >> 8, return_inverse=True)
            n, d = np.bincount(where, c), np.bincount(where)
            cost = np.log2((n + d)[where] / c).astype(np.float32)
            self.levels.append((own, cost, context, np.log2((n + d) / d).astype(np.float32)))

    def costs(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.float32)
        left = np.arange(len(keys))
        for k in range(ORDER, -1, -1):
            own, cost, context, escape = self.levels[k]
            key = keys[left] & ((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(own, key), len(own) - 1)
            hit = own[at] == key
            out[left[hit]] += cost[at[hit]]
            left, key = left[~hit], key[~hit]
            at = np.minimum(np.searchsorted(context, key >> 8), len(context) - 1)
            known = context[at] == key >> 8
            out[left[known]] += escape[at[known]]
        out[left] += 8
        return out


class Model:
    """Trees of several languages, and the costs of byte runs met so far."""

    def __init__(self, trees: dict[str, np.ndarray]) -> None:
        self.names = sorted(trees)
        self.trees = [Tree(trees[x]) for x in self.names]
        self._forget()

    def _forget(self) -> None:
        self.known, self.cost = np.zeros(0, np.int64), np.zeros((0, len(self.names)), np.float32)

    def _costs(self, keys: np.ndarray) -> np.ndarray:
        """Costs of distinct ascending keys, a column for each language."""
        at = np.minimum(np.searchsorted(self.known, keys), max(0, len(self.known) - 1))
        new = keys[self.known[at] != keys] if len(self.known) else keys
        if len(new):
            if len(self.known) + len(new) > REMEMBERED:
                self._forget()
                new = keys
            cost = np.stack([t.costs(new) for t in self.trees], axis=1)
            place = np.searchsorted(self.known, new)
            self.known, self.cost = np.insert(self.known, place, new), np.insert(self.cost, place, cost, axis=0)
            at = np.searchsorted(self.known, keys)
        return self.cost[at]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths: a row for each text, a column for each language."""
        if len(offsets) == 2 and len(data) > CHUNK_BYTES:
            return self._long(data)
        out = np.zeros((len(offsets) - 1, len(self.names)))
        if len(data):
            keys, at = np.unique(grams(data, offsets), return_inverse=True)
            cost = self._costs(keys)
            full = np.flatnonzero(np.diff(offsets))
            for k in range(len(self.names)):
                out[full, k] = np.add.reduceat(cost[at, k], offsets[full], dtype=np.float64)
        return out

    def _long(self, data: np.ndarray) -> np.ndarray:
        """A single very long text, part by part; each part but the first begins with the context before it."""
        total = np.zeros((1, len(self.names)))
        for a in range(0, len(data), CHUNK_BYTES):
            lead = min(a, ORDER)
            part = data[a - lead : a + CHUNK_BYTES]
            keys, counts = np.unique(grams(part, np.array([0, len(part)]))[lead:], return_counts=True)
            total += counts @ self._costs(keys).astype(np.float64)
        return total


def has_letter(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letters = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))))
    out = np.diff(letters[offsets]) > 0
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[k] = any(map(str.isalpha, texts[k].as_py()))
    return out


def trees(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, np.ndarray]:
    """Per language the distinct byte runs of its sample with their counts."""
    spark = docs.sparkSession
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"), F.octet_length(text_col).alias("b"))
    sizes = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("first")).collect()  # a row for each language
    if not sizes:
        return {}
    # Some twice as many documents as are wanted, by the hash alone; the first by hash is always among them.
    span = F.col("h").cast("double") + 2.0**63
    borders = spark.createDataFrame([(r.l, r.first, 2.0**64 * min(1.0, 2 * SAMPLE_DOCS / r.n)) for r in sizes], "l string, first long, border double")
    some = rows.join(F.broadcast(borders), "l").where((span < F.col("border")) | (F.col("h") == F.col("first")))
    order = Window.partitionBy("l").orderBy("h", "t")
    upto = F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = some.select("l", "h", "b", "t").withColumns({"place": F.row_number().over(order), "upto": upto})
    chosen = ranked.where((F.col("place") == 1) | ((F.col("place") <= SAMPLE_DOCS) & (F.col("upto") <= SAMPLE_BYTES))).select("l", "t")

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in chunks([pa.RecordBatch.from_arrays([pa.array(pdf["t"], pa.string())], ["t"])], "t"):
            keys, counts = np.unique(grams(*buffers(b.column(0))), return_counts=True)
            merged, at = np.unique(np.concatenate((found, keys)), return_inverse=True)
            found, n = merged, np.bincount(at, np.concatenate((n, counts))).astype(np.int64)
        return pd.DataFrame({"l": [key[0]], "runs": [np.stack((found, n)).tobytes()]})

    got = chosen.groupBy("l").applyInPandas(count, "l string, runs binary").collect()  # bounded like the samples
    return {r.l: np.frombuffer(r.runs, np.int64).reshape(2, -1) for r in got if len(r.runs)}


def language_id(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows with ``held_out`` are not learnt from."""
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    book = docs.sparkSession.sparkContext.broadcast(trees(docs, ~held, text_col, lang_col, id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(book.value) if book.value else None
        for b in chunks(batches, "t"):
            data, offsets = buffers(b.column(2))
            names, scores = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            ok = has_letter(b.column(2), data, offsets)
            if model is not None and ok.any():
                bits, size = model.bits(data, offsets), np.maximum(1, np.diff(offsets))
                best = bits.argmin(axis=1)
                gap = (bits - bits.min(axis=1, keepdims=True)) * (np.minimum(size, EVIDENCE) / size)[:, None]
                names[ok] = np.array(model.names, object)[best[ok]]
                scores[ok] = (1 / np.exp2(-gap).sum(axis=1))[ok]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("d"), held.alias("h"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['d']}, held_out boolean, lang_pred string, score double")
