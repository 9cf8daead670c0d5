"""Token counts that follow edits.

A document is kept as its pre-tokens (the pieces that the tokenizer's pattern cuts, of which each is encoded
by itself) in blocks of about ``BLOCK``, and a segment tree over the blocks holds sums of characters and
tokens. An edit finds its place by the tree, takes out the blocks that it touches with some context before, and cuts
and encodes anew until a cut falls on an old one behind the edit; from there on the old cuts hold, because the
pattern never looks back. Only the sums above the changed blocks are computed again.

Context: a match depends on where it begins and on what follows. Whatever begins ``CONTEXT`` pre-tokens or more
before the edit has all that it looked at before the edit: a match looks one character beyond its own end.

Nulls and bounds: a null text is empty and takes edits like one. Edits with a null field, or with a place behind
the end, are cut to the text; a negative or reversed range is empty at its start. Edits of a document apply in
order of ``seq`` to what the earlier ones left; ties go by start, end and replacement. Edits of unknown
documents are left out. Rows that repeat an id each take that id's edits. A very long text is kept whole, in blocks. Other
columns than the named ones are not read, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, kept

BLOCK = 64
CONTEXT = 2
REMEMBERED = 1_000_000


class Counter:
    """Tokens of pre-tokens, remembered."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, words: list[str]) -> list[int]:
        known = self.known
        new = {w for w in words if w not in known}
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(words)
            encode = self.encoding.encode_ordinary
            for w in new:
                known[w] = len(encode(w))
        return [known[w] for w in words]


class Sums:
    """A segment tree of sums over two columns; setting a leaf updates the sums above it."""

    def __init__(self, leaves: list[tuple[int, int]]) -> None:
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.a, self.b = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (x, y) in enumerate(leaves):
            self.a[self.size + k], self.b[self.size + k] = x, y
        for k in range(self.size - 1, 0, -1):
            self.a[k], self.b[k] = self.a[2 * k] + self.a[2 * k + 1], self.b[2 * k] + self.b[2 * k + 1]

    def set(self, leaf: int, x: int, y: int) -> None:
        k = self.size + leaf
        self.a[k], self.b[k] = x, y
        while k := k >> 1:
            self.a[k], self.b[k] = self.a[2 * k] + self.a[2 * k + 1], self.b[2 * k] + self.b[2 * k + 1]

    def find(self, x: int) -> tuple[int, int]:
        """(leaf in which the running sum of the first column passes x, the sum before that leaf)."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if x >= before + self.a[k]:
                before += self.a[k]
                k += 1
        return k - self.size, before

    def before(self, leaf: int) -> int:
        k, total = self.size + leaf, 0
        while k > 1:
            if k & 1:
                total += self.a[k - 1]
            k >>= 1
        return total


class Document:
    """A text whose token count follows its edits."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter, self.text, self.encoded = counter, text, 0
        self._blocks([*map(len, words := counter.pattern.findall(text))], counter.counts(words))

    def _blocks(self, lengths: list[int], tokens: list[int]) -> None:
        self.lengths = [lengths[k : k + BLOCK] for k in range(0, len(lengths), BLOCK)] or [[]]
        self.tokens = [tokens[k : k + BLOCK] for k in range(0, len(tokens), BLOCK)] or [[]]
        self.sums = Sums([(sum(x), sum(y)) for x, y in zip(self.lengths, self.tokens, strict=True)])

    @property
    def n_tokens(self) -> int:
        return self.sums.b[1]

    @property
    def n_words(self) -> int:
        return sum(map(len, self.lengths))

    def edit(self, start: int, end: int, replacement: str) -> int:
        """Replace text[start:end]; returns how many pre-tokens were encoded anew."""
        old = len(self.text)
        start = min(max(start, 0), old)
        end = min(max(end, start), old)
        self.text = self.text[:start] + replacement + self.text[end:]
        shift = len(replacement) - (end - start)
        # The first pre-token to cut anew: some before the one that the edit touches.
        leaf, at = self.sums.find(max(0, start - 1))
        leaf = min(leaf, len(self.lengths) - 1)
        at = self.sums.before(leaf)
        k = 0
        while k < len(self.lengths[leaf]) - 1 and at + self.lengths[leaf][k] < start:
            at += self.lengths[leaf][k]
            k += 1
        for _ in range(CONTEXT):
            if k == 0 and leaf == 0:
                break
            if k == 0:
                leaf -= 1
                k = len(self.lengths[leaf])
                if not k:
                    continue
            k -= 1
            at -= self.lengths[leaf][k]
        # Cut on until a cut meets an old one behind the edit.
        words, place, old_leaf, old_k, old_at = [], at, leaf, k, at
        met = False
        while place < len(self.text):
            match = self.counter.pattern.match(self.text, place)
            words.append(match.group())
            place = match.end()
            while old_at < max(end, place - shift) and old_leaf < len(self.lengths):
                if old_k < len(self.lengths[old_leaf]):
                    old_at += self.lengths[old_leaf][old_k]
                    old_k += 1
                else:
                    old_leaf, old_k = old_leaf + 1, 0
            if old_at == place - shift and old_at >= end:
                met = True
                break
        if not met:
            old_leaf, old_k = len(self.lengths), 0
        if old_leaf < len(self.lengths) and old_k == len(self.lengths[old_leaf]):
            old_leaf, old_k = old_leaf + 1, 0
        new_tokens = self.counter.counts(words)
        rest = old_leaf < len(self.lengths) and old_k > 0
        lengths = self.lengths[leaf][:k] + [*map(len, words)] + (self.lengths[old_leaf][old_k:] if rest else [])
        tokens = self.tokens[leaf][:k] + new_tokens + (self.tokens[old_leaf][old_k:] if rest else [])
        stop = old_leaf + rest  # leaves from leaf to stop are replaced
        if len(lengths) <= 4 * BLOCK and stop > leaf:
            for own in range(leaf, stop):
                self.lengths[own], self.tokens[own] = (lengths, tokens) if own == leaf else ([], [])
                self.sums.set(own, sum(self.lengths[own]), sum(self.tokens[own]))
        else:  # a leaf grew too long: deal the blocks anew
            self._blocks([x for y in (*self.lengths[:leaf], lengths, *self.lengths[stop:]) for x in y], [x for y in (*self.tokens[:leaf], tokens, *self.tokens[stop:]) for x in y])
        self.encoded += len(words)
        return len(words)


def counter(ranks_path: str, pattern: str) -> Counter:
    return kept(("token_counts", ranks_path, pattern), lambda: Counter(ranks_path, pattern))


def token_counts(docs: DataFrame, edits: Column, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_words_edited, n_tokens_edited, n_edits, n_encoded: counts before and after all edits.

    ``edits`` is a column of array<struct<start: int, end: int, replacement: string>> in order. ``n_encoded``
    pre-tokens were encoded for the edits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(ranks_path, pattern)
        for b in chunks(batches, "t"):
            rows = []
            for text, todo in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                doc = Document(text or "", own)
                before = (doc.n_words, doc.n_tokens)
                for e in todo or ():
                    if e is not None and e["start"] is not None and e["end"] is not None and e["replacement"] is not None:
                        doc.edit(e["start"], e["end"], e["replacement"])
                rows.append((*before, doc.n_words, doc.n_tokens, len(todo or ()), doc.encoded))
            columns = np.array(rows, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns)], _NAMES)

    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), edits.alias("e"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['d']}, " + ", ".join(f"{n} long" for n in _NAMES[1:]))


_NAMES = ["doc_id", "n_words", "n_tokens", "n_words_edited", "n_tokens_edited", "n_edits", "n_encoded"]


def edits_by_document(edits: DataFrame) -> DataFrame:
    """(doc_id, edits) from a table (doc_id, seq, start, end, replacement): a list for each document, as it is edited at once.

    A document's edits must fit in memory, as its text must.
    """
    fields = F.struct("seq", "start", "end", "replacement")
    listed = F.array_sort(F.collect_list(fields))
    return edits.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.transform(listed, lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["replacement"].alias("replacement"))).alias("edits"))


def revision_edits(text_col: str = "text") -> Column:
    """A fixed set of edits that every text takes: an insertion, a deletion over a word's end, and a replacement."""
    n = F.coalesce(F.char_length(F.col(text_col)), F.lit(0))

    def edit(start: Column, length: int, replacement: str) -> Column:
        return F.struct(start.cast("int").alias("start"), (start + length).cast("int").alias("end"), F.lit(replacement).alias("replacement"))

    return F.array(edit(F.floor(n / 4), 0, " (as amended)"), edit(F.floor(n / 2), 12, ""), edit(F.floor(n * 3 / 4), 5, "it's 2026 \n"))
