"""Language-model scoring with a hashed maximum-entropy model over class-factored outcomes.

A token's probability is that of its class, given the tokens before it, times that of the token within its class.
The most frequent tokens are classes of their own; the others fall into classes by their last two letters, and within
these a token's only feature is itself, whose best weight is its count (plus one; a token that was never seen counts as
the one unknown token of its class), so that factor is closed-form. The class is a softmax over hashed features of the
history: the class before, the two before as a pair, the second and the third before (skips), and the word before.

The weights are trained by rounds of distributed gradient updates over all training documents. A round's gradient is what
was observed of each (feature, class) less what the model expects; tasks add it up over their documents and send one
table each. As every token has one feature of each template, a weight may move by log(observed / expected) over the number of
templates, which never lowers the likelihood (generalised iterative scaling). Expectations of the first round, from weights
of zero, are the classes' shares and need no pass. Scoring works in batches of sparse rows of the weight table.

Counts are exact, cover all training documents, and tell words apart by their bytes. At most ``KNOWN`` words, the most
frequent ones, are broadcast; the counts of all rarer ones are joined in by word, aggregated per document before. What is
broadcast is bounded by ``KNOWN`` and by the model's fixed size, whatever the corpus.

Nulls: a null or empty text is its end token alone. Rows with a null id train (their remainder is unknown, hence not
the held-out one) and are scored. Every row is scored by itself, so repeats score alike. A very long text is worked on as
one. If nothing is to be learnt from, every token is unknown. An empty table gives an empty result. Other
columns than the named ones are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, Lexicon, Words, buffers, chunks, cut, kept, mix, uncut

#: Frequent tokens that are classes of their own, and classes of the others.
SINGLE, TAIL = 32, 32
CLASSES = SINGLE + TAIL
#: Rows of the hashed templates.
HASHED = 2048
#: Templates: class before; pair of classes before; second before; third before; word before.
SIZES = (CLASSES + 1, HASHED, CLASSES + 1, CLASSES + 1, HASHED)
OFFSETS = tuple(int(x) for x in np.cumsum((0, *SIZES[:-1])))
ROWS = sum(SIZES)
#: Rounds over the training documents after the closed-form one.
ROUNDS = 2
#: Most frequent words that are broadcast with their counts.
KNOWN = 250_000
#: Tokens of the class distribution that are added to what was observed and expected of each feature.
PRIOR = 5.0
#: The end token; no word holds white space.
END = b"\n"
BATCH = 4096


#: Of each pair of classes before, the rows of its three features: class before, the pair, second before.
_PAIRS = np.arange((CLASSES + 1) ** 2)
PAIR_ROWS = np.stack((_PAIRS % (CLASSES + 1) + OFFSETS[0], (mix(_PAIRS.astype(np.uint64)) % np.uint64(HASHED)).astype(np.int64) + OFFSETS[1], _PAIRS // (CLASSES + 1) + OFFSETS[2]))


class Tokens:
    """The tokens of a chunk of texts, each text with its end, as numbers of distinct words (the end is the last)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        words = self.words = Words(data, offsets, BLANK)
        rows = len(offsets) - 1
        self.sizes = words.per_row + 1
        self.rows = np.repeat(np.arange(rows), self.sizes)
        self.first, kind = words.distinct()
        self.kind = np.full(len(kind) + rows, len(self.first))
        self.kind[np.arange(len(kind)) + words.rows] = kind
        # The class by letters: the last two, where one sign at the end is told apart.
        d, begin, last = words.data, words.starts[self.first], words.ends[self.first] - 1
        if len(self.first):
            mark = (d[last] < 48) & (last > begin)
            last = last - mark
            pair = d[last].astype(np.uint64) | np.where(last > begin, d[last - 1], 0).astype(np.uint64) << np.uint64(8) | mark.astype(np.uint64) << np.uint64(16)
            self.tail = np.append((mix(pair) % np.uint64(TAIL)).astype(np.int64), 0)
            self.hashed = np.append((words.hashes()[self.first] % np.uint64(HASHED)).astype(np.int64), 0)
        else:
            self.tail = self.hashed = np.zeros(1, np.int64)

    def column(self, which: np.ndarray) -> pa.Array:
        """The words of some kinds."""
        own = which < len(self.first)
        packed = self.words.packed(self.first[which[own]])
        if own.all():
            return packed
        return pa.concat_arrays([packed, pa.array([END], pa.binary())]).take(pa.array(np.where(own, np.cumsum(own) - 1, len(packed))))

    def numbers(self, lexicon: Lexicon, end: int) -> np.ndarray:
        """Each kind's number in the lexicon, -1 if it is not there; ``end`` is the end token's."""
        return np.append(lexicon.find(self.words, self.first), end)

    def classes(self, singles: Singles) -> np.ndarray:
        number = self.numbers(singles.lexicon, singles.end)
        return np.where(number >= 0, number, self.tail + SINGLE)[self.kind]

    def features(self, classes: np.ndarray) -> np.ndarray:
        return histories(classes, self.hashed[self.kind], self.rows)


def histories(classes: np.ndarray, hashed: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each token what its history has: the pair of classes before (which names three features), the third before, the word before."""

    def back(values: np.ndarray, n: int, start: int) -> np.ndarray:
        """The value n tokens before, ``start`` where the text begins later."""
        out = np.full(len(values), start, np.int64)
        if len(values) > n:
            out[n:] = np.where(rows[n:] == rows[:-n], values[:-n], start)
        return out

    c1, c2, c3 = (back(classes, k, CLASSES) for k in (1, 2, 3))
    return np.stack((c2 * (CLASSES + 1) + c1, c3 + OFFSETS[3], back(hashed, 1, 0) + OFFSETS[4]))


class Singles:
    """The words that are classes of their own; ``end`` is the end token's class, -1 if it is none."""

    def __init__(self, words: list[bytes]) -> None:
        self.end = words.index(END) if END in words else -1
        self.lexicon = Lexicon(words)


class Model:
    """Class distribution and weights of (feature, class)."""

    def __init__(self, observed: np.ndarray) -> None:
        """``observed``: how often each class followed each feature. The closed-form first round is done here."""
        self.observed = observed.reshape(ROWS, CLASSES)
        seen = self.observed[: SIZES[0]].sum(axis=0) + 1.0
        self.prior = seen / seen.sum()
        self.log_prior = np.log(self.prior).astype(np.float32)
        self.weights = np.zeros((ROWS, CLASSES), np.float32)
        self.update(self.observed.sum(axis=1)[:, None] * self.prior)

    def update(self, expected: np.ndarray) -> None:
        """One step along the gradient, observed less expected."""
        smooth = PRIOR * self.prior
        self.weights += (np.log((self.observed + smooth) / (expected + smooth)) / len(SIZES)).astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "observed"}

    def _batches(self, features: np.ndarray, classes: np.ndarray) -> Iterator[tuple]:
        """(features, classes, logits, exponentials, their sums). Logits are sums of a few logarithms of shares, so none runs over."""
        pairs, ones = self.weights[PAIR_ROWS].sum(axis=0) + self.log_prior, np.ones(CLASSES, np.float32)
        for a in range(0, len(classes), BATCH):
            pair, third, word = features[:, a : a + BATCH]
            logits = pairs.take(pair, axis=0)
            logits += self.weights.take(third, axis=0)
            logits += self.weights.take(word, axis=0)
            p = np.exp(logits)
            yield features[:, a : a + BATCH], classes[a : a + BATCH], logits, p, p @ ones

    def log_class(self, features: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """ln P(class | history) of each token."""
        out = [logits[np.arange(len(c)), c] - np.log(total) for _, c, logits, _, total in self._batches(features, classes)]
        return np.concatenate([*out, np.zeros(0)])

    def expect(self, features: np.ndarray, classes: np.ndarray, pairs: np.ndarray, out: np.ndarray) -> float:
        """Add what the model expects of each (pair of classes before, class) and (feature, class); returns the log-likelihood."""
        likelihood = 0.0
        for f, c, logits, p, total in self._batches(features, classes):
            likelihood += float((logits[np.arange(len(c)), c] - np.log(total)).sum())
            p /= total[:, None]
            for row, table in zip(f, (pairs, out, out), strict=True):
                order = np.argsort(row.astype(np.int16), kind="stable")
                own = row[order]
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                table[own[first]] += np.add.reduceat(p.take(order, axis=0), first, axis=0)
        return likelihood


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Empty sums by (pair of classes before, class) and by (feature, class)."""
    return np.zeros((len(_PAIRS), CLASSES)), np.zeros((ROWS, CLASSES))


def folded(pairs: np.ndarray, out: np.ndarray) -> np.ndarray:
    """One table: a pair's sums go to all of its features."""
    for rows in PAIR_ROWS:
        np.add.at(out, rows, pairs)
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(w, tail, c): each training token, its class by letters, and its count. Tasks add up before they shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("lm_score")
        waiting: list[pa.Table] = []
        size = 0

        def merged() -> pa.Table:
            return pa.concat_tables(waiting).group_by("w").aggregate([("tail", "min"), ("c", "sum")]).rename_columns(["w", "tail", "c"])

        for b in chunks(batches, "t"):
            t = Tokens(*buffers(b.column(0)))
            which = np.arange(len(t.first) + 1)
            waiting.append(pa.table([t.column(which), pa.array(t.tail), pa.array(np.bincount(t.kind, minlength=len(which)))], names=["w", "tail", "c"]))
            size += len(which)
            if size > 2_000_000:
                waiting = [merged()]
                size = len(waiting[0])
                if size > 1_000_000:
                    yield from waiting.pop().to_batches(1 << 16)
                    size = 0
        if waiting:
            yield from merged().to_batches(1 << 16)

    return docs.select("t").mapInArrow(run, "w binary, tail long, c long").groupBy("w").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


def coded(docs: DataFrame, singles) -> DataFrame:
    """(classes, hashed, sizes): the tokens of some texts as one row each of packed numbers, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("lm_score")
        for b in chunks(batches, "t"):
            t = Tokens(*buffers(b.column(0)))
            cells = [t.classes(singles.value).astype(np.uint8), t.hashed[t.kind].astype(np.uint16), t.sizes.astype(np.uint32)]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["classes", "hashed", "sizes"])

    return cut(docs.select("t").mapInArrow(run, "classes binary, hashed binary, sizes binary"), "coded", compression="zstd")


def summed(codes: DataFrame, work) -> tuple[np.ndarray, float]:
    """The sum over all texts of what ``work(features, classes, *tables)`` adds to ``tables``, folded, and of what it returns.

    Each task sends one row for each row of the table that it has touched; the driver gets one table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("lm_score")
        sums, more = tables(), 0.0
        for b in batches:
            for cells in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                classes, hashed, sizes = (np.frombuffer(c, kind).astype(np.int64) for c, kind in zip(cells, (np.uint8, np.uint16, np.uint32), strict=True))
                more += work(histories(classes, hashed, np.repeat(np.arange(len(sizes)), sizes)), classes, *sums)
        table = folded(*sums)
        own = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, ROWS)), pa.array([*(table[k].tobytes() for k in own), np.array([more]).tobytes()], pa.binary())], ["row", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for row, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out[row] = out.get(row, 0.0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([v.tobytes() for v in out.values()], pa.binary())], ["row", "v"])

    sent = codes.mapInArrow(run, "row long, v binary")
    sums = sent.repartition("row").mapInArrow(add, "row long, v binary").toArrow()  # as many rows as the model has, at most
    out, more = np.zeros((ROWS, CLASSES)), 0.0
    for row, v in zip(sums.column("row").to_pylist(), sums.column("v").to_pylist(), strict=True):
        if row == ROWS:
            more = float(np.frombuffer(v)[0])
        else:
            out[row] = np.frombuffer(v)
    return out, more


def train(docs: DataFrame, singles: Singles, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model, and its log-likelihood (of classes) before each round after the first."""
    context = docs.sparkSession.sparkContext
    codes = coded(docs, context.broadcast(singles))

    def count(features: np.ndarray, classes: np.ndarray, pairs: np.ndarray, out: np.ndarray) -> float:
        for row, table in zip(features, (pairs, out, out), strict=True):
            table += np.bincount(row * CLASSES + classes, minlength=table.size).reshape(table.shape)
        return 0.0

    model, history = Model(summed(codes, count)[0]), []
    for _ in range(rounds):
        book = context.broadcast(model)

        def expect(*args: np.ndarray, book=book) -> float:
            return book.value.expect(*args)

        expected, likelihood = summed(codes, expect)
        history.append(likelihood)
        model.update(expected)
        book.destroy()
    uncut(codes)
    return model, history


def frequent(words: DataFrame, most: int) -> DataFrame:
    """(w, c) of the words in the upper bands of frequency, as many whole bands as have ``most`` words at most.

    Bands are eighths of a power of two, so a few hundred numbers find the border and nothing is sorted.
    """
    band = F.floor(F.log2(F.col("c")) * 8)
    left, border = most, None
    for row in sorted(words.groupBy(band.alias("b")).count().collect(), key=lambda r: -r.b):
        left -= row["count"]
        if left < 0:
            break
        border = row.b
    return words.where(band >= border if border is not None else F.lit(False)).select("w", F.col("c").cast("long").alias("c"))


def lm_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", known_words: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("d"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("t"))
    training = rows.where("not held")
    words = cut(vocabulary(training), "vocabulary")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    leading = words.orderBy(F.desc("c"), "w").limit(SINGLE).collect()
    singles = Singles([bytes(r.w) for r in leading])
    # The classes of the others: all their tokens, their words, and one unknown word.
    mass = np.ones(TAIL)
    for row in words.groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("w")).collect():  # a row for each class
        mass[row.tail] += row.c + row.w
    for row in leading:
        mass[row.tail] -= row.c + 1
    model, _ = train(training, singles)
    known = frequent(words, KNOWN if known_words is None else known_words).toArrow()
    known = {bytes(r.w): r.c for r in leading} | dict(zip(known.column("w").to_pylist(), known.column("c").to_pylist(), strict=True))
    spelt, counts = list(known), np.array([*known.values()], np.int64)
    end = spelt.index(END) if END in spelt else -1
    book, table, log_mass = context.broadcast((model, singles)), context.broadcast((Lexicon(spelt), counts)), np.log10(mass)
    del known
    names = ["doc_id", "row", "held_out", "n_tokens", "n_known", "base", "score", "rare"]
    schema = f"doc_id {dict(rows.dtypes)['d']}, row long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<w:binary,n:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("lm_score")
        model, singles = book.value
        lexicon, counts = table.value
        for b in chunks(batches, "t"):
            t = Tokens(*buffers(b.column(2)))
            classes = t.classes(singles)
            tail = classes >= SINGLE
            log_class = model.log_class(t.features(classes), classes) / np.log(10)
            number = t.numbers(lexicon, end)
            here = (number >= 0)[t.kind]
            plus = (np.where(number >= 0, np.log10(counts[number] + 1.0), 0.0) if len(counts) else np.zeros(len(number)))[t.kind]
            m = b.num_rows
            base = np.bincount(t.rows, plus, m)
            score = np.bincount(t.rows, log_class + np.where(tail, plus - log_mass[np.maximum(classes - SINGLE, 0)], 0.0), m)
            # The others' counts come by a join: (row, word) with repeats added up.
            lost = np.flatnonzero(~here)
            pairs, times = np.unique(t.rows[lost] << 32 | t.kind[lost], return_counts=True)
            items = pa.StructArray.from_arrays([t.column(pairs & 0xFFFFFFFF), pa.array(times)], ["w", "n"])
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(pairs >> 32, minlength=m)))), pa.int32()), items)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(1), pa.array(t.sizes), pa.array(np.bincount(t.rows, here, m).astype(np.int64)), pa.array(base), pa.array(score), rare], names)

    # The rows' numbers hold from here on, as they are written.
    scored = cut(rows.select("d", "held", "t", F.monotonically_increasing_id().alias("row")).mapInArrow(run, schema), "scored")
    more, plus = F.lit(0).cast("long"), F.lit(0.0)
    if v > len(counts):
        wanted = scored.select("row", F.explode("rare").alias("x")).select("row", "x.w", "x.n")
        sums = wanted.join(words.select("w", "c"), "w").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("plus"))
        scored = scored.drop("rare").join(sums, "row", "left")
        more, plus = F.coalesce("more", F.lit(0)), F.coalesce("plus", F.lit(0.0))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + more).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + plus - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("score") + plus).alias("score"),
    )
