"""Line deduplication with a suffix array over line ids, built by distributed prefix doubling.

The corpus is one sequence of line ids, document after document in order of doc_id. A repeated run is a run of lines of one
document, with at least ``MIN_WORDS`` words in all, that occurs at an earlier place too (in an earlier document
or earlier in its own; the two may overlap). Lines that a later copy covers are deleted; the first copy stays.

Prefix doubling sorts all suffixes by their first line, their first two, four, ... lines: a suffix's rank at
depth 2n comes from its rank at depth n and that of the suffix n lines on. Ranks are places in a range-partitioned sort of
the distinct pairs, so a line that makes up a third of the corpus is one pair. Suffixes whose prefix is unique
are dropped: nothing longer can repeat there. For any length, suffixes that share a prefix of it are an interval of the
suffix array with that longest common prefix at least, and the ranks at the power of two below, at the prefix's
start and at its end, name the interval. A line of a repeated run is in the shortest run with enough words from some line on, or
it ends the shortest such run up to it, and both lie within the repeated run. So for each line only the intervals of these two
lengths are looked at, and doubling stops at the longest of them.

Lines compare after white space is trimmed and its runs become one blank, by 128 bits of hash. Nulls: a null text is
an empty one; rows with a null id come first. Rows that agree in id and text are one document, and each takes its
deletions. Empty texts and lines have no words and repeat freely. Ties cannot occur, as places are unique.
A very long text's lines are a row each, wherever they are
compared. An empty table gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, cut, fresh, kept, uncut, whole_id

MIN_WORDS = 10
_PLACE = ["_d", "_t", "_n"]


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_d, _t, _n): document and line number; _h1, _h2: the line; _span and _back: lines from it on, and up to it, until there are enough words; 0 if there never are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("line_dedup")
        for b in chunks(batches, "text"):
            digests, words, per_doc = [], [], []
            for text in b.column(2).to_pylist():
                own = (text or "").encode().split(b"\n")
                per_doc.append(len(own))
                for line in own:
                    w = line.split()
                    words.append(len(w))
                    digests.append(xxhash.xxh3_128_digest(b" ".join(w)))
            per_doc = np.array(per_doc)
            doc = np.repeat(np.arange(b.num_rows), per_doc)
            ends = np.cumsum(per_doc)
            sums = np.cumsum(words)
            before = sums - words
            reach = np.searchsorted(sums, before + min_words)
            place = np.arange(len(words))
            span = np.where(reach < ends[doc], reach - place + 1, 0)
            begin = np.searchsorted(before, sums - min_words, "right") - 1
            back = np.where(begin >= (ends - per_doc)[doc], place - begin + 1, 0)
            hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            take = pa.array(doc)
            cells = [b.column(0).take(take), b.column(1).take(take), *map(pa.array, (place - (ends - per_doc)[doc], hashes[:, 0], hashes[:, 1], span, back))]
            for at in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_arrays([c.slice(at, 1 << 16) for c in cells], [*_PLACE, "_h1", "_h2", "_span", "_back"])

    rows = docs.select(whole_id(docs, id_col).alias("_d"), _text_key(text_col).alias("_t"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "_d long, _t long, _n long, _h1 long, _h2 long, _span long, _back long").withColumn("_d", F.coalesce("_d", F.lit(-(1 << 63)).cast("long")))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose key repeats, with ``_rank`` in place of the key: ascending with it, equal for equal keys."""
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    ordered = repeated.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Partition number and place in it: as good as a place in the whole. Written at once, since sampled ranges may not come out alike twice.
    table = cut(ordered.withColumn("_rank", F.monotonically_increasing_id()), "ranks")
    out = cut(rows.join(table, keys).drop(*keys), "suffixes")
    uncut(table)
    return out


def doubled(ranks: DataFrame, depth: int) -> DataFrame:
    """Ranks at twice the depth, of the suffixes whose prefix of that length repeats."""
    ahead = ranks.select("_d", "_t", (F.col("_n") - depth).alias("_n"), F.col("_rank").alias("_r2"))
    return _ranked(ranks.withColumnRenamed("_rank", "_r1").join(ahead, _PLACE), ["_r1", "_r2"])


def later_copies(all_lines: DataFrame) -> DataFrame:
    """(_d, _t, _n, _span): runs of _span lines, with enough words, that occur earlier too."""
    places = all_lines.select(*_PLACE, "_span").union(all_lines.where("_back > 1").select("_d", "_t", F.col("_n") - F.col("_back") + 1, "_back"))
    longest = all_lines.agg(F.max(F.greatest("_span", "_back"))).first()[0] or 0
    ranks = _ranked(all_lines.select(*_PLACE, "_h1", "_h2"), ["_h1", "_h2"])
    found, depth = None, 1
    while depth <= longest:
        starts = places.where((F.col("_span") >= depth) & (F.col("_span") < 2 * depth)).join(ranks.withColumnRenamed("_rank", "_a"), _PLACE)
        end = ranks.select("_d", "_t", F.col("_n").alias("_m"), F.col("_rank").alias("_b"))
        runs = starts.withColumn("_m", F.col("_n") + F.col("_span") - depth).join(end, ["_d", "_t", "_m"])
        interval = ["_span", "_a", "_b"]
        place = F.struct(*_PLACE)
        first = runs.groupBy(*interval).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
        copies = runs.join(first, interval).where(place != F.col("_first")).select(*_PLACE, "_span")
        found = copies if found is None else found.union(copies)
        depth *= 2
        if depth <= longest:
            ranks = doubled(ranks, depth // 2)
            if ranks.isEmpty():
                break
    return found if found is not None else places.where("false")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the remaining lines as text, and two last columns n_lines and n_deleted (lines before, and deleted).

    Where there are columns of these names, the added ones have underscores behind theirs.
    """
    all_lines = cut(lines(docs, min_words, id_col, text_col), "lines")
    # A document has two runs for each of its lines at most; what they cover is marked where it is rebuilt.
    gone = later_copies(all_lines).groupBy("_d", "_t").agg(F.collect_list(F.struct("_n", "_span")).alias("_gone"))
    # The columns go by number meanwhile, so that none clashes with those added here.
    names = docs.columns
    text_at, numbered = names.index(text_col), [f"c{k}" for k in range(len(names))]
    keyed = docs.toDF(*numbered).withColumns({"_d": F.coalesce(F.col(numbered[names.index(id_col)]).cast("long"), F.lit(-(1 << 63)).cast("long")), "_t": _text_key(numbered[text_at])})
    joined = keyed.join(gone, ["_d", "_t"], "left").select(*numbered, "_gone")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("line_dedup")
        for b in chunks(batches, numbered[text_at]):
            texts, n_lines, n_gone = [], [], []
            for text, lost in zip(b.column(text_at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                own = (text or "").split("\n")
                n_lines.append(len(own))
                n_gone.append(0)
                if lost:
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, [r["_n"] for r in lost], 1)
                    np.add.at(edge, [r["_n"] + r["_span"] for r in lost], -1)
                    drop = np.cumsum(edge[:-1]) > 0
                    n_gone[-1] = int(drop.sum())
                    own = [x for x, d in zip(own, drop.tolist(), strict=True) if not d]
                texts.append("\n".join(own))
            cells = b.columns[:-1]
            cells[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cells, pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], [*names, *added])

    added = [fresh("n_lines", names), fresh("n_deleted", names)]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])
    return joined.mapInArrow(rebuild, schema)


def brute_force(docs: list[tuple[int, str | None]], min_words: int = MIN_WORDS) -> dict[int, str]:
    """doc_id -> remaining text, by comparing every run with every earlier one; doc_ids are distinct."""
    split = {d: (t or "").split("\n") for d, t in sorted(docs, key=lambda x: x[0])}
    flat = [(d, n, tuple(line.encode().split())) for d, own in split.items() for n, line in enumerate(own)]
    gone: set[tuple[int, int]] = set()
    for i in range(len(flat)):
        for j in range(i):
            k = 0
            while i + k < len(flat) and flat[i + k][0] == flat[i][0] and flat[j + k][0] == flat[j][0] and flat[i + k][2] == flat[j + k][2]:
                k += 1
            if sum(len(flat[i + x][2]) for x in range(k)) >= min_words:
                gone.update((flat[i + x][0], flat[i + x][1]) for x in range(k))
    return {d: "\n".join(line for n, line in enumerate(own) if (d, n) not in gone) for d, own in split.items()}
