"""Benchmark decontamination with a distributed positional inverted index.

The index is split by documents into segments of bounded size, as search engines do. A segment is a row of a table in the
shared folder: its documents' ids and word counts, all its distinct terms, and for each term the ascending
word positions at which it occurs. A phrase is found by taking the postings of its rarest term, shifted to the phrase's
start, and intersecting them with the shifted postings of its other terms, from rare to common. For a match in proximity
the rarest term's postings are followed to the nearest occurrences of the phrase's next and previous terms, with at most
``slop`` words between in all. Building and searching are narrow, so no key can become hot.

The benchmark is searched in parts of bounded size, each broadcast by itself to all segments, which are built once.

Nulls and edge cases: a null or empty text has no words (n_words 0, nothing hit); benchmark items without
words have no window; items with a null id are left out, as they cannot be named. Repeated items and
repeated documents are each reported. An empty benchmark leaves every document clean, an empty document
table gives an empty result. A very long text is a segment of its own, a very long word a term like any other. Other
columns than the named ones are not read, whatever their names. An id that is not a whole number raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Lexicon, Words, buffers, chunks, cut, fresh, kept, whole_id

_ROWS = ["doc_ids", "has_id", "n_words"]
_LISTS = ["terms", "term_ends", "list_ends", "postings"]
SEGMENT = "segment long, " + ", ".join(f"{c} binary" for c in (*_ROWS, *_LISTS))
#: Bytes of benchmark text that one broadcast may hold (its windows take some ten times as many).
BROADCAST_BYTES = 8_000_000
#: Words between the terms of a match in proximity, in the registered query.
SLOP = 2
_LOW = np.int64(0xFFFFFFFF)


def split_words(text: str | None) -> list[bytes]:
    """The words of one text, in plain Python; the driver uses it for benchmark items."""
    raw = ALNUM[np.frombuffer((text or "").encode(), np.uint8)].tobytes()
    return [w for w in raw.split(b"\0") if w]


class Phrases:
    """Distinct phrases over a term dictionary, packed for broadcast."""

    def __init__(self, phrases: dict[tuple[bytes, ...], set]) -> None:
        terms = sorted({w for p in phrases for w in p})
        number = {w: k for k, w in enumerate(terms)}
        self.lexicon = Lexicon(terms)
        self.lengths = np.array([len(p) for p in phrases], np.int64)
        self.terms = np.full((len(phrases), int(self.lengths.max(initial=0))), -1, np.int64)
        for k, p in enumerate(phrases):
            self.terms[k, : len(p)] = [number[w] for w in p]
        self.items = [sorted(items) for items in phrases.values()]


def windows_of(items: list[tuple], size: int) -> dict[tuple[bytes, ...], set]:
    out: dict[tuple[bytes, ...], set] = {}
    for item, text in items:
        words = split_words(text)
        for k in range(max(1, len(words) - size + 1) if words else 0):
            out.setdefault(tuple(words[k : k + size]), set()).add(str(item))
    return out


class Index:
    """The postings of one segment."""

    def __init__(self, terms: np.ndarray, term_ends: np.ndarray, list_ends: np.ndarray, postings: np.ndarray) -> None:
        self.terms, self.term_ends, self.list_ends, self.postings = terms, term_ends, list_ends, postings

    @classmethod
    def of(cls, words: Words) -> Index:
        first, kind = words.distinct()
        packed = words.packed(first)
        by = np.argsort(kind, kind="stable")
        ends = np.frombuffer(packed.buffers()[1], np.int32)[1:]
        return cls(np.frombuffer(packed.buffers()[2] or b"", np.uint8), ends, np.cumsum(np.bincount(kind, minlength=len(first))), by)

    def cells(self) -> list[bytes]:
        """For storing; postings as distances, which pack well."""
        gaps = np.diff(self.postings, prepend=0)
        return [self.terms.tobytes(), self.term_ends.astype("<i4").tobytes(), self.list_ends.astype("<i4").tobytes(), gaps.astype("<i4").tobytes()]

    @classmethod
    def stored(cls, terms: bytes, term_ends: bytes, list_ends: bytes, gaps: bytes) -> Index:
        return cls(np.frombuffer(terms, np.uint8), np.frombuffer(term_ends, "<i4"), np.frombuffer(list_ends, "<i4").astype(np.int64), np.cumsum(np.frombuffer(gaps, "<i4"), dtype=np.int64))

    def keys(self, lexicon: Lexicon) -> np.ndarray:
        """The postings lists of the lexicon's terms as term << 32 | position, ascending."""
        words = Words.__new__(Words)
        words.data, words.sums, words.ends = self.terms, None, self.term_ends.astype(np.int64)
        words.starts = np.concatenate(([0], words.ends[:-1])) if len(words.ends) else words.ends
        term = lexicon.find(words)
        own = np.flatnonzero(term >= 0)
        own = own[np.argsort(term[own])]
        n = np.diff(self.list_ends, prepend=0)[own]
        ends = np.cumsum(n)
        place = np.arange(int(n.sum())) + np.repeat(self.list_ends[own] - ends, n)
        return np.repeat(term[own] << 32, n) | self.postings[place]


def _rows(batch: pa.RecordBatch, words: Words) -> list[bytes]:
    ids = batch.column(0)
    return [np.asarray(ids.fill_null(0), np.int64).tobytes(), np.asarray(ids.is_valid()).astype(np.uint8).tobytes(), words.per_row.astype(np.int64).tobytes()]


def build_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of the positional index of ``docs``, over all their terms, written to the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("decontaminate")
        for k, b in enumerate(chunks(batches, "t")):
            words = Words(*buffers(b.column(1)), ALNUM)
            cells = [*_rows(b, words), *Index.of(words).cells()]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 32 | k]), *(pa.array([c], pa.binary()) for c in cells)], ["segment", *_ROWS, *_LISTS])

    return cut(docs.select(whole_id(docs, id_col).alias("d"), F.col(text_col).alias("t")).mapInArrow(build, SEGMENT), "index", compression="zstd")


def _rarest(book: Phrases, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, its terms' places from rare to common, position of the rarest) for each posting of a phrase's rarest term."""
    begin = np.searchsorted(keys, np.arange(len(book.lexicon) + 1, dtype=np.int64) << 32)
    begin, count = begin[:-1], np.diff(begin)
    if not len(book.lengths) or not len(keys):
        none = np.zeros(0, np.int64)
        return none, np.zeros((len(book.lengths), 1), np.int64), none
    rarity = np.where(book.terms >= 0, count[book.terms], np.iinfo(np.int64).max)
    order = np.argsort(rarity, axis=1, kind="stable")
    least = np.take_along_axis(rarity, order[:, :1], 1)[:, 0]
    live = np.flatnonzero(least > 0)
    n = least[live]
    phrase = np.repeat(live, n)
    place = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[book.terms[live, order[live, 0]]], n)
    return phrase, order, keys[place] & _LOW


def phrase_matches(book: Phrases, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase number, position of its first word) of every occurrence in a segment, over document ends too."""
    phrase, order, at = _rarest(book, keys)
    start = at - order[phrase, 0]
    keep = start >= 0
    phrase, start = phrase[keep], start[keep]
    for k in range(1, book.terms.shape[1]):  # the other terms, from rare to common
        if not len(phrase):
            break
        offset = order[phrase, k]
        term = book.terms[phrase, offset]
        want = (term << 32) | (start + offset)
        near = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        keep = (term < 0) | (keys[near] == want)
        phrase, start = phrase[keep], start[keep]
    return phrase, start


def proximity_matches(book: Phrases, keys: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase number, first position, last position): the terms in order with at most ``slop`` words between in all.

    A row for each occurrence of a phrase's rarest term that is part of a match: the closest there is on either side.
    """
    phrase, order, at = _rarest(book, keys)
    anchor, first, last, free = order[phrase, 0], at, at, np.full(len(at), slop)
    for side in (1, -1):
        for k in range(1, book.terms.shape[1]):
            if not len(phrase):
                break
            offset = anchor + side * k
            inside = (offset >= 0) & (offset < book.lengths[phrase])
            term = np.where(inside, book.terms[phrase, np.clip(offset, 0, book.terms.shape[1] - 1)], 0)
            now = last if side > 0 else first
            want = (term << 32) | now
            near = np.searchsorted(keys, want, "right") if side > 0 else np.searchsorted(keys, want) - 1
            there = (near >= 0) & (near < len(keys))
            found = keys[np.clip(near, 0, len(keys) - 1)]
            there &= found >> 32 == term
            step = np.where(inside, np.abs((found & _LOW) - now) - 1, 0)
            keep = ~inside | (there & (step <= free))
            moved = np.where(inside, found & _LOW, now)
            last, first = (moved, first) if side > 0 else (last, moved)
            phrase, anchor, first, last, free = phrase[keep], anchor[keep], first[keep], last[keep], (free - step)[keep]
    return phrase, first, last


FOUND = "segment long, row long, doc_id long, n_words long, hit_from array<long>, hit_to array<long>, items array<string>, near array<string>"


def look(book: Phrases, keys: np.ndarray, n_words: np.ndarray, slop: int) -> dict[int, tuple[list, list, set, set]]:
    """By row of a segment: first and last word of each merged stretch that matches, the items, and those in proximity."""
    ends = np.cumsum(n_words)
    out: dict[int, tuple[list, list, set, set]] = {}
    phrase, start = phrase_matches(book, keys)
    last = start + book.lengths[phrase] - 1
    doc = np.searchsorted(ends, start, "right")
    keep = doc == np.searchsorted(ends, last, "right")
    order = np.lexsort((start[keep], doc[keep]))
    for d, p, a, z in zip(*(x[keep][order].tolist() for x in (doc, phrase, start, last)), strict=True):
        base = int(ends[d] - n_words[d])
        froms, tos, items, _ = out.setdefault(d, ([], [], set(), set()))
        if tos and a - base <= tos[-1] + 1:
            tos[-1] = max(tos[-1], z - base)
        else:
            froms.append(a - base)
            tos.append(z - base)
        items.update(book.items[p])
    if slop:
        phrase, start, last = proximity_matches(book, keys, slop)
        doc = np.searchsorted(ends, start, "right")
        keep = doc == np.searchsorted(ends, last, "right")
        pairs = np.unique(doc[keep] << 32 | phrase[keep])
        for d, p in zip((pairs >> 32).tolist(), (pairs & _LOW).tolist(), strict=True):
            out.setdefault(d, ([], [], set(), set()))[3].update(book.items[p])
    return out


def search(segments: DataFrame, phrases, slop: int = 0, hits_only: bool = False) -> DataFrame:
    """What one broadcast ``Phrases`` finds in each row of the index; with ``hits_only`` rows without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("decontaminate")
        book: Phrases = phrases.value
        for batch in batches:
            for segment, ids, has, n_words, *lists in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                ids, has, n_words = np.frombuffer(ids, np.int64), np.frombuffer(has, np.uint8), np.frombuffer(n_words, np.int64)
                out = look(book, Index.stored(*lists).keys(book.lexicon), n_words, slop)
                rows = np.array(sorted(out) if hits_only else range(len(ids)), np.int64)
                cells = [out.get(d, ((), (), (), ())) for d in rows.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), segment, np.int64)),
                        pa.array(rows),
                        pa.array(ids[rows], pa.int64(), mask=has[rows] == 0),
                        pa.array(n_words[rows]),
                        pa.array([c[0] for c in cells], pa.list_(pa.int64())),
                        pa.array([c[1] for c in cells], pa.list_(pa.int64())),
                        pa.array([sorted(c[2]) for c in cells], pa.list_(pa.string())),
                        pa.array([sorted(c[3]) for c in cells], pa.list_(pa.string())),
                    ],
                    ["segment", "row", "doc_id", "n_words", "hit_from", "hit_to", "items", "near"],
                )

    return segments.mapInArrow(run, FOUND)


def listed(segments: DataFrame) -> DataFrame:
    """(segment, row, doc_id, n_words) of all rows of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, ids, has, n_words in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ids, has = np.frombuffer(ids, np.int64), np.frombuffer(has, np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), segment, np.int64)), pa.array(np.arange(len(ids))), pa.array(ids, pa.int64(), mask=has == 0), pa.array(np.frombuffer(n_words, np.int64))], ["segment", "row", "doc_id", "n_words"])

    return segments.select("segment", *_ROWS).mapInArrow(run, "segment long, row long, doc_id long, n_words long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slop: int = SLOP, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, items, near, hit_from, hit_to.

    ``near`` are the items of which a window occurs with at most ``slop`` other words between its words (exact matches
    included). The index is built once. A benchmark within one part needs no shuffle; of a larger one each part's hits are
    written to the shared folder, and put together by segment and row.
    """
    segments = build_segments(docs, id_col, text_col)
    books = _books(docs, benchmark, size, item_col, item_text, broadcast_bytes)
    book = next(books)
    if (more := next(books, None)) is None:
        found = search(segments, book, slop)
    else:
        hits = None
        while book is not None:
            part = cut(search(segments, book, slop, hits_only=True), "hits")
            book.destroy()
            hits = part if hits is None else hits.unionByName(part)
            book, more = more, next(books, None)
        found = listed(segments).join(_together(hits), ["segment", "row"], "left")
    lists = {c: F.coalesce(F.col(c), F.array().cast(kind)) for c, kind in (("hit_from", "array<long>"), ("hit_to", "array<long>"), ("items", "array<string>"), ("near", "array<string>"))}
    n_hit = F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, z: z - a + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.withColumns(lists).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
        "items",
        "near",
        "hit_from",
        "hit_to",
    )


def flagged(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with a last column that says whether a window occurs, decided for each row by its text alone.

    Each segment is searched by the worker that has just indexed it, and not stored. The column is named
    ``contaminated``, with underscores behind it if there is such a column. Of a larger benchmark the parts follow one another,
    each over the table that the one before has written.
    """
    n, at, name = len(docs.columns), docs.columns.index(text_col), fresh("contaminated", docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BooleanType())])

    def marked(rows: DataFrame, book) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept("decontaminate")
            for b in chunks(batches, text_col):
                words = Words(*buffers(b.column(at)), ALNUM)
                dirty = np.zeros(b.num_rows, bool)
                dirty[[d for d, x in look(book.value, Index.of(words).keys(book.value.lexicon), words.per_row, 0).items() if x[2]]] = True
                if b.num_columns > n:
                    dirty |= np.asarray(b.column(n))
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(dirty)], schema.names)

        return rows.mapInArrow(run, schema)

    books = _books(docs, benchmark, size, item_col, item_text, broadcast_bytes)
    out, book = docs, next(books)
    while (more := next(books, None)) is not None:
        out = cut(marked(out, book), "flagged")
        book.destroy()
        book = more
    return marked(out, book)


def _books(docs: DataFrame, benchmark: DataFrame, size: int, item_col: str, item_text: str, broadcast_bytes: int) -> Iterator:
    """The benchmark's broadcast parts, one at least. The driver holds the texts of one part at a time."""
    context = docs.sparkSession.sparkContext
    items, n, any_ = [], 0, False
    for row in benchmark.select(F.col(item_col).cast("string"), item_text).where(F.col(item_col).isNotNull()).toLocalIterator():
        items.append((row[0], row[1]))
        n += len((row[1] or "").encode())
        if n >= broadcast_bytes:
            yield context.broadcast(Phrases(windows_of(items, size)))
            items, n, any_ = [], 0, True
    if items or not any_:
        yield context.broadcast(Phrases(windows_of(items, size)))


def _together(found: DataFrame) -> DataFrame:
    """Of several parts' results for a row of the index, one."""
    spans = F.flatten(F.collect_list(F.arrays_zip("hit_from", "hit_to")))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    rows = found.groupBy("segment", "row").agg(F.array_sort(spans).alias("s"), union("items"), union("near"))
    kind = "array<struct<hit_from:long,hit_to:long>>"

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["hit_from"].alias("hit_from"), F.greatest(last["hit_to"], x["hit_to"]).alias("hit_to"))
        return F.when((F.size(acc) > 0) & (x["hit_from"] <= last["hit_to"] + 1), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    merged = rows.withColumn("m", F.aggregate("s", F.array().cast(kind), step))
    return merged.select("segment", "row", F.col("m.hit_from").alias("hit_from"), F.col("m.hit_to").alias("hit_to"), "items", "near")


def brute_force(docs: list[tuple], items: list[tuple], size: int = 10, slop: int = SLOP) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) by looking at every window of every document."""
    book = windows_of([x for x in items if x[0] is not None], size)
    by_length: dict[int, dict] = {}
    for p, own in book.items():
        by_length.setdefault(len(p), {})[p] = own
    out = []
    for doc, text in docs:
        words, hit, found, near = split_words(text), set(), set(), set()
        for n, own in by_length.items():
            for k in range(len(words) - n + 1):
                if (got := own.get(tuple(words[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= got
        for phrase, own in book.items():
            for k in (k for k, w in enumerate(words) if w == phrase[0]):
                rest = iter(words[k + 1 : k + len(phrase) + slop])
                if all(w in rest for w in phrase[1:]):
                    near |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit), len(near)))
    return out
