"""Token ids in binary shards, compressed by a Re-Pair grammar with random access.

Documents are dealt into files by ranges of their id, so file after file holds them in ascending order. A file is a run
of blocks, the shards of the grammar: a block holds whole documents of about ``BLOCK_BYTES`` of text, so that a worker's memory
is bounded, and stands alone, little-endian:

    8 bytes   magic ``RPGRAM1\\n``
    4 int64   documents, rules, symbols, first id that is a rule
    int64     document ids; uint8: whether each has one
    int64     where each document's symbols end
    2 int32   left and right symbol of each rule
    int64     expansion length of each rule
    int32     the symbols of all documents

Rules never reach over the end of a document, so one document is read by expanding its own symbols, and
the expansion lengths lead to any place in it. Blocks are cells of a binary column in Parquet files that Spark writes
to the shared folder, so a lost executor's blocks are written anew.

Texts are encoded by the tokenizers library, one distinct word after the other: this vocabulary drops white
space, and words between ASCII white space (or between an ASCII letter and ASCII punctuation) do not touch
each other's ids. Words that were seen before come from a bounded table, by their bytes.

Nulls: a null or empty text is the end id alone. Rows with a null id come first, with a null id; rows that
repeat an id are all kept, next to each other. A very long text is a block of its own. An id that is not a whole number
is an error. Other columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, BLANK_AS_IS, Remembered, Words, buffers, chunks, kept, shared_path, whole_id

MAGIC = b"RPGRAM1\n"
END = 2
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: Words that a worker remembers; the table starts anew when it is full.
REMEMBERED = 1_200_000
#: A rule takes 16 bytes (two symbols and a length) and saves four wherever it is used: from so many uses on it pays.
LEAST = 5
#: New words are given to the library together, so many in a text, with a mark between any two.
JOINED, MARK = 256, "\x01"


class Encoder(Remembered):
    """Ids of words, by the tokenizers library, remembered."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(REMEMBERED)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of the library's own would contend for the others
        self.library = Tokenizer.from_file(path)
        a, mark, z, all_three = self.alone(["a", MARK, "z", f"a {MARK} z"])
        self.mark = mark[0] if len(mark) == 1 and a + mark + z == all_three and mark != a else None

    def alone(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A call has a cost of its own, which words share that are joined; the mark's id shows where one ends.

        A group in which the mark's id occurs more often than that, since a word holds the mark itself, is encoded word by word.
        """
        if self.mark is None:
            return super().flat(words)
        texts = [w.decode() for w in words]
        groups = [texts[k : k + JOINED] for k in range(0, len(texts), JOINED)]
        parts, sizes = [], []
        for group, ids in zip(groups, self.alone([f" {MARK} ".join((*g, "")) for g in groups]), strict=True):
            own = np.array(ids, np.int32)
            ends = np.flatnonzero(own == self.mark)
            if len(ends) == len(group):
                parts.append(np.delete(own, ends))
                sizes.append(np.diff(ends, prepend=-1) - 1)
            else:
                own, size = super().flat([t.encode() for t in group])
                parts.append(own)
                sizes.append(size)
        return np.concatenate(parts), np.concatenate(sizes)

    def fresh(self, words: list[bytes]) -> list[list[int]]:
        return self.alone([w.decode() for w in words])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, ids in each row)."""
        # The vocabulary is lower case, but the strings of its special tokens are not folded.
        table = BLANK_AS_IS if b"<|" in data.tobytes() else BLANK
        words = Words(data, offsets, table, breaks(data))
        return self.ids(words, np.where(words.data, words.data, data).tobytes())


_CLASS = np.zeros(256, np.uint8)  # 1: ASCII letter; 2: ASCII punctuation but ' < | >, which contractions and special tokens hold
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[b for b in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)) if chr(b) not in "'<|>"]] = 2


def breaks(data: np.ndarray) -> np.ndarray:
    """Where a letter and punctuation meet; both are ASCII, so neither normalising nor the word pattern joins them."""
    kind = _CLASS[data]
    return np.flatnonzero(kind[1:] * kind[:-1] == 2) + 1


def encoder(path: str) -> Encoder:
    return kept(("token_ids", path), lambda: Encoder(path))


def compress(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(symbols, ends of documents in symbols, rules, expansion lengths, first rule).

    Rounds go on until no pair of neighbours occurs ``LEAST`` times, as rarer pairs do not pay for a rule. A round counts
    all pairs (of a run of one symbol every other one) and replaces each occurrence that is more frequent than both
    pairs it overlaps; of equally frequent ones the greater pair of symbols counts as more. So the most frequent pair is
    replaced wherever it is, along with all others that it does not touch.
    """
    seq, doc_end = ids.astype(np.int64), ends.astype(np.int64)
    base = top = int(seq.max(initial=-1)) + 1
    rules: list[np.ndarray] = []
    lengths = np.ones(base, np.int64)
    last = np.zeros(len(seq), bool)  # of a document; no pair begins there
    last[doc_end[doc_end > 0] - 1] = True
    live = np.flatnonzero(~last)  # a pair that was too rare stays so, and is not looked at again
    while len(live):
        keys = (seq[live] << 32) | seq[live + 1]
        once = np.ones(len(keys), bool)
        same = np.flatnonzero((keys[1:] == keys[:-1]) & (live[1:] == live[:-1] + 1)) + 1  # only runs of one symbol repeat a pair at once
        if len(same):
            first = np.concatenate(([True], same[1:] != same[:-1] + 1))
            begin = same[first][np.cumsum(first) - 1]
            once[same[(same - begin) % 2 == 0]] = False
        kind, pairs = pd.factorize(keys)
        counts = np.bincount(kind[once], minlength=len(pairs))
        good = np.flatnonzero(counts >= LEAST)
        if not len(good):
            break
        rank = np.zeros(len(pairs), np.int32)
        rank[good[np.lexsort((pairs[good], counts[good]))]] = np.arange(1, len(good) + 1)
        own = rank[kind]
        rest = live[own > 0]  # still frequent, if not replaced now
        own[~once] = 0
        weight = np.zeros(len(seq) + 2, np.int32)  # of the pair at each place, with one place before and behind
        weight[live + 1] = own
        keep = (own > weight[live]) & (own > weight[live + 2])
        at, rule = live[keep], kind[keep]
        used = np.bincount(rule, minlength=len(pairs)) >= LEAST
        keep = used[rule]
        at, rule = at[keep], rule[keep]
        pair = pairs[used]
        rules.append(np.stack((pair >> 32, pair & 0xFFFFFFFF), axis=1).astype(np.int32))
        lengths = np.concatenate((lengths, lengths[rules[-1][:, 0]] + lengths[rules[-1][:, 1]]))
        seq[at] = top + (np.cumsum(used) - 1)[rule]
        last[at] |= last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        place = np.cumsum(stay) - 1  # of what stays, in what is left
        look = np.zeros(len(seq) + 1, bool)
        look[rest] = True
        look[at] = look[at - 1] = True  # place -1 is the spare one
        before = at - 1
        gone = before[(before >= 0) & ~stay[before]]
        look[gone - 1] = True  # where the symbol before has just been merged itself
        live = place[np.flatnonzero(look[:-1] & stay & ~last)]
        doc_end = np.where(doc_end > 0, place[doc_end - 1] + 1, 0)
        seq, last = seq[stay], last[stay]
        top += len(pair)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int32)
    return seq, doc_end, table, lengths[base:], base


def expand(seq: np.ndarray, table: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for, rule by rule: for a few symbols."""
    while len(seq) and (rule := seq >= base).any():
        size = np.where(rule, 2, 1)
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        out[at[~rule]] = seq[~rule]
        pairs = table[seq[rule] - base]
        out[at[rule]], out[at[rule] + 1] = pairs[:, 0], pairs[:, 1]
        seq = out
    return seq


def pack(doc_ids: np.ndarray, has_id: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> bytes:
    seq, doc_end, table, lengths, base = compress(ids, ends)
    head = MAGIC + struct.pack("<4q", len(doc_ids), len(table), len(seq), base)
    cells = [(doc_ids, "<i8"), (has_id, "u1"), (doc_end, "<i8"), (table, "<i4"), (lengths, "<i8"), (seq, "<i4")]
    return head + b"".join(np.ascontiguousarray(x, kind).tobytes() for x, kind in cells)


class Block:
    """A block as read back; ``document`` and ``slice`` expand no more than they need."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise ValueError("not a block of token ids")
        n, rules, symbols, self.base = struct.unpack_from("<4q", raw, 8)
        at = 40

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.has_id, self.ends = take(n, "<i8"), take(n, "u1"), take(n, "<i8")
        self.table, self.lengths, self.seq = take(2 * rules, "<i4").reshape(-1, 2), take(rules, "<i8"), take(symbols, "<i4")

    def _sizes(self, seq: np.ndarray) -> np.ndarray:
        sizes = np.ones(len(seq), np.int64)
        sizes[seq >= self.base] = self.lengths[seq[seq >= self.base] - self.base]
        return sizes

    def document(self, k: int) -> np.ndarray:
        return expand(self.seq[self.ends[k - 1] if k else 0 : self.ends[k]], self.table, self.base)

    def slice(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document ``k``."""
        own = self.seq[self.ends[k - 1] if k else 0 : self.ends[k]]
        upto = np.cumsum(self._sizes(own))
        a, z = int(np.searchsorted(upto, start, "right")), int(np.searchsorted(upto, stop, "left")) + 1
        skip = start - (int(upto[a - 1]) if a else 0)
        return expand(own[a:z], self.table, self.base)[skip : skip + stop - start]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each document ends in them)."""
        pool = expand(np.arange(self.base, self.base + len(self.table)), self.table, self.base)
        begin = np.cumsum(self.lengths) - self.lengths
        sizes = self._sizes(self.seq)
        upto = np.concatenate(([0], np.cumsum(sizes)))
        rule = np.flatnonzero(self.seq >= self.base)
        out = np.empty(int(upto[-1]), np.int32)
        out[upto[:-1][self.seq < self.base]] = self.seq[self.seq < self.base]
        n, own = sizes[rule], self.seq[rule] - self.base
        skip = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(upto[rule], n) + skip] = pool[np.repeat(begin[own], n) + skip]
        return out, upto[self.ends]


def write_shards(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write shards of (shard, base, n_ids, block); base: ids of the shard before the block."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, base = TaskContext.get().partitionId(), 0
        for b in chunks(batches, "t", BLOCK_BYTES):
            ids, sizes = encoder(tokenizer).encode(*buffers(b.column(1)))
            rows = np.repeat(np.arange(len(sizes)), sizes)
            ends = np.cumsum(sizes + 1)
            out = np.full(int(ends[-1]), END, np.int32)
            out[np.arange(len(ids)) + rows] = ids
            doc = b.column(0)
            block = pack(np.asarray(doc.fill_null(0), np.int64), np.asarray(doc.is_valid()).astype(np.uint8), out, ends)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([base]), pa.array([len(out)]), pa.array([block], pa.binary())], ["shard", "base", "n_ids", "block"])
            base += len(out)

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(whole_id(docs, id_col).alias("d"), F.col(text_col).alias("t"))
    dealt = rows.repartitionByRange(shards, F.col("d").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(F.col("d").asc_nulls_first())
    dealt.mapInArrow(run, "shard int, base long, n_ids long, block binary").write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema("shard int, base long, n_ids long, block binary").parquet(path)
    totals = sorted((r.shard, r.n) for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())  # a row for each shard
    before, total = [], 0
    for shard, n in totals:
        before.append((shard, total))
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch.column(2)[k].as_py())
                ids, ends = block.all()
                raw = memoryview(ids.astype("<u4").tobytes())
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                cells = [pa.array(np.full(len(ends), batch.column(0)[k].as_py(), np.int32)), pa.array(block.doc_ids, mask=block.has_id == 0), pa.array(starts + batch.column(1)[k].as_py()), pa.array(ends - starts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cells, ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.select("shard", "base", "block").mapInArrow(run, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    offsets = F.broadcast(spark.createDataFrame(before, "shard int, before long"))
    return rows.join(offsets, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    path = path or shared_path(docs.sparkSession, "token-ids")
    write_shards(docs, tokenizer, path)
    return read_shards(docs.sparkSession, path)
