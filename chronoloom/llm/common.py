"""What the text operators share: column names, shared storage, and vectorised work on UTF-8 buffers.

The byte helpers read the buffers of Arrow string columns in place, so a batch of texts is one
``uint8`` array with offsets; no Python object is made per text or word.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the contracts: a blank and 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step takes at a time, so that its arrays stay some tens of MB.
CHUNK_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text, which the contracts use to deal rows into folds."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


_kept: dict = {}


def trim() -> None:
    """Hand freed memory back to the machine, where the C library can."""
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def kept(key: object, make=lambda: None):
    """What a worker process keeps from task to task under ``key``: one thing at a time.

    Workers serve all stages of a job. Whatever another operator left is dropped and its memory handed back, so
    that a pipeline needs no more than its largest stage.
    """
    if key not in _kept:
        _kept.clear()
        gc.collect()
        trim()
        _kept[key] = make()
    return _kept[key]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder.

    Where the session names none, a folder of this machine serves as long as there is no other (a local master);
    on a cluster that is an error, as executors would not see each other's files.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not re.match(r"local(\[[^-]*\])?$", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = f"file://{tempfile.gettempdir()}/chronoloom-checkpoints"
        context.setCheckpointDir(root)
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it as long as there is such a column (Spark's names do not tell case apart)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def whole_id(df: DataFrame, col: str) -> Column:
    """The id as a long. A null stays null; an id that is not a whole number is an error, not a null."""
    own = F.col(col)
    if isinstance(df.schema[col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return own.cast("long")
    number = own.cast("string").try_cast("long")
    return F.when(own.isNull() | number.isNotNull(), number).otherwise(F.raise_error(F.lit(f"{col} is not a whole number")).cast("long"))


def cut(df: DataFrame, name: str = "stage", compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def uncut(*tables: DataFrame | None) -> None:
    """Remove the files of tables that ``cut`` wrote and nothing will read again."""
    for df in tables:
        if df is not None and (path := getattr(df, "cut_path", None)):
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def chunks(batches: Iterable[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``size`` bytes; a longer single text is a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, to - at)
            at = to
    trim()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows."""
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def byte_table(separators: Iterable[int]) -> np.ndarray:
    """Byte to byte with A-Z lower-cased and separators as 0."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words are runs of digits, letters a-z (after folding) and bytes from 0x80.
ALNUM = byte_table(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
#: Words are runs of anything but white space, byte 0 included (``Words`` sees to it).
BLANK = byte_table([32, *range(9, 14)])
#: The same without folding.
BLANK_AS_IS = np.where(BLANK == 0, BLANK, np.arange(256, dtype=np.uint8))

#: Random numbers for a byte at each of a word's first places, a line of 256 for each place.
_NEAR = 32
_PLACED = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256 * _NEAR, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash can serve."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of a chunk of texts: byte ranges in ``data``, the row each is in, and 64-bit hashes.

    A hash is a sum over a number for each byte and its place in the word, got for all words at once from one
    running sum. Hashes only find words: ``distinct`` and ``Lexicon`` compare the bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, breaks: np.ndarray | None = None) -> None:
        """``breaks``: positions at which a new word begins besides."""
        self.offsets, self.sums = offsets, None
        self.data = folded = table[data]
        n = len(folded)
        inside = folded != 0
        if table[0] == 0 and table[1]:
            inside |= data == 0
        first = np.ones(n, bool)
        first[1:] = ~inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < n]
        if breaks is not None:
            cuts = np.concatenate((cuts, breaks))
        first[cuts] = True
        last = np.ones(n, bool)
        last[:-1] = ~inside[1:]
        last[cuts[cuts > 0] - 1] = True
        self.starts = np.flatnonzero(first & inside)
        self.ends = np.flatnonzero(last & inside) + 1
        self.rows = np.searchsorted(offsets, self.starts, "right") - 1
        self.per_row = np.bincount(self.rows, minlength=len(offsets) - 1)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        n, sums = len(self.data), self.sums
        if sums is None:
            begin = np.zeros(n, np.int64)
            begin[self.starts] = self.starts
            code = np.arange(n)
            code -= np.maximum.accumulate(begin, out=begin)
            code <<= 8
            code += self.data
            number = _PLACED.take(code, mode="clip")
            far = np.flatnonzero(code >= len(_PLACED))
            number[far] = mix(code[far].astype(np.uint64))
            sums = self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(number, out=sums[1:])
        return mix(sums[self.ends] - sums[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def distinct(self, raw: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each kind, kind of each word). ``raw``: the bytes that decide, if not ``data``."""
        if not len(self):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = self.data if raw is None else raw
        kind, kinds = pd.factorize(self.hashes())
        first = np.empty(len(kinds), np.int64)
        first[kind[::-1]] = np.arange(len(kind) - 1, -1, -1)
        like = first[kind]
        again = np.flatnonzero(like != np.arange(len(kind)))
        if same_bytes(raw, self.starts[again], self.ends[again], raw, self.starts[like[again]], self.ends[like[again]]).all():
            return first, kind
        text = raw.tobytes()  # two words of one hash: the bytes number the words
        kind, _ = pd.factorize(np.array([text[a:z] for a, z in zip(self.starts.tolist(), self.ends.tolist(), strict=True)], object))
        first = np.empty(kind.max() + 1, np.int64)
        first[kind[::-1]] = np.arange(len(kind) - 1, -1, -1)
        return first, kind

    def packed(self, which: np.ndarray) -> pa.Array:
        """The bytes of some words as a binary column."""
        size = self.ends[which] - self.starts[which]
        ends = np.cumsum(size)
        data = self.data[np.arange(int(size.sum())) + np.repeat(self.starts[which] - ends + size, size)]
        return pa.BinaryArray.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(data)])


def same_bytes(x: np.ndarray, start: np.ndarray, end: np.ndarray, y: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether x[start:end] equals y[begin:stop], for many at once."""
    size = end - start
    out = size == stop - begin
    live = np.flatnonzero(out & (size > 0))
    size = size[live]
    ends = np.cumsum(size)
    place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[live] - ends + size, size)
    wrong = np.flatnonzero(x[place] != y[place + np.repeat(begin[live] - start[live], size)])
    out[live[np.searchsorted(ends, wrong, "right")]] = False
    return out


class Lexicon:
    """A set of words, packed for broadcast: an offset for each and one run of bytes."""

    def __init__(self, words: list[bytes], table: np.ndarray | None = None) -> None:
        """``table``: how the bytes of texts are folded that words are looked up for."""
        self.ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        self.starts = self.ends - np.array([len(w) for w in words], np.int64)
        self.data = np.frombuffer(b"".join(words), np.uint8)
        if table is not None:
            self.data = table[self.data]
        hashes = hash_ranges(self.data, self.starts, self.ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, words: Words, which: np.ndarray | None = None) -> np.ndarray:
        """The number of each word (or of some), -1 for those that are not here. Bytes decide, not hashes."""
        hashes = words.hashes() if which is None else words.hashes()[which]
        out = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)]) if len(self) else np.zeros(0, np.int64)
        near = np.searchsorted(self.hashes, hashes[at])
        while len(at):  # words of one hash are next to each other, and tried in turn
            here = near < len(self)
            at, near = at[here], near[here]
            here = self.hashes[near] == hashes[at]
            at, near = at[here], near[here]
            own, number = at if which is None else which[at], self.order[near]
            same = same_bytes(words.data, words.starts[own], words.ends[own], self.data, self.starts[number], self.ends[number])
            out[at[same]] = number[same]
            at, near = at[~same], near[~same] + 1
        return out


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words at these places, equal to those of ``Words``; each is taken as one word whatever its bytes."""
    own = Words.__new__(Words)
    own.sums, own.data, own.starts, own.ends = None, data, starts[ends > starts], ends[ends > starts]
    out = np.full(len(starts), mix(np.zeros(1, np.uint64))[0])
    out[ends > starts] = own.hashes()
    return out


class Remembered:
    """Ids of distinct words, remembered in a bounded table; ``fresh`` gives those of new words."""

    def __init__(self, most: int, batch: int = 4096) -> None:
        self.most, self.batch = most, batch
        self._reset()

    def fresh(self, words: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids in each) of new words."""
        ids = self.fresh(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for y in ids for x in y), np.int32, int(sizes.sum())), sizes

    def _reset(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.at = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.int32)
        self.used = 0

    def _learn(self, words: list[bytes]) -> None:
        for k in range(0, len(words), self.batch):
            part = words[k : k + self.batch]
            flat, sizes = self.flat(part)
            n = len(self.slots)
            while len(self.pool) < self.used + len(flat):
                self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
            while len(self.at) < n + len(part):
                self.at, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.size))
            self.pool[self.used : self.used + len(flat)] = flat
            self.size[n : n + len(part)] = sizes
            self.at[n : n + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.used += len(flat)
            self.slots.update(zip(part, range(n, n + len(part)), strict=True))

    def ids(self, words: Words, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids in each row); ``raw``: the bytes that ``words`` point into."""
        rows = len(words.offsets) - 1
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        first, number = words.distinct(np.frombuffer(raw, np.uint8))
        distinct = [raw[a:z] for a, z in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
        if len(self.slots) + len(distinct) > self.most:
            self._reset()
        known = np.fromiter(map(self.slots.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(known < 0)
        known[new] = len(self.slots) + np.arange(len(new))
        self._learn([distinct[k] for k in new.tolist()])
        slot = known[number]
        sizes = self.size[slot]
        ends = np.cumsum(sizes)
        ids = self.pool[np.arange(int(ends[-1])) + np.repeat(self.at[slot] - ends + sizes, sizes)]
        return ids, np.bincount(words.rows, sizes, rows).astype(np.int64)
