"""Toxicity by class-conditional Kneser-Ney models.

Each class of texts, toxic and ordinary, has a Kneser-Ney model of its words after the word before them. An
expression of two words backs off to the word in the class; a word is the path of its prefixes (three bytes, four, ...
and the whole word), of which each step has continuation counts (before how many different words it was seen
in the class), and backs off to shared counts of both classes, on which they agree. So a rare expression falls back on its
word, a rare word on its prefixes, and an unknown one says next to nothing. Discounts are estimated from the counts of
counts. Expressions met less than ``LEAST`` times and steps met less than ``STEP_LEAST`` times in both classes together
are rare, and back off at once.

The two log-likelihoods of a text are compared by their difference over its length, and so are those of its
passages of several sizes, the worst of which counts, so that a few words can mark a long text. A logistic curve,
fitted on labelled rows that the counts have not seen, turns these differences into a score.

The classifier is fitted on a bounded sample of labelled rows (``SAMPLE`` of each class are expected, dealt by a
hash of the id; copies of a text count once); scoring reads every text whole. Ids, languages, sources and labels are
never features.

Nulls: a null or empty text scores like one without words. Labels other than 0 and 1, and labels whose document
is missing, are left out; a document with contradicting labels counts in both classes. Without labels of both
classes every score is 0. Repeated documents score alike. A very long text is read whole, as one. An empty table gives
an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, buffers, chunks, fresh, kept, mix

#: Expected number of labelled rows of each class, at most, from which a model is fitted.
SAMPLE = {0: 4000, 1: 4000}
WINDOWS = (1, 4, 16)
#: Bytes of the prefixes; the whole word comes last.
PREFIXES = (3, 4, 5, 6, 7, 8, 10, 12)
THRESHOLD = 0.7
#: How often an expression, or a word before others, is met in all to say something of its own; rarer ones back off.
LEAST = 30
#: The same for the steps of a word's path.
STEP_LEAST = 4
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 for those that are not there."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0).astype(values.dtype)


def paths(words: Words) -> np.ndarray:
    """Hashes of each word's prefixes and of the word, a row each; a step beyond a word's end repeats the word."""
    whole = words.ends
    rows = []
    for n in PREFIXES:
        words.ends = np.minimum(words.starts + n, whole)
        rows.append(words.hashes())
    words.ends = whole
    return np.stack([*rows, words.hashes()])


def before(words: Words, hashes: np.ndarray) -> np.ndarray:
    """The word before, 0 at the start of a text."""
    out = np.zeros(len(hashes), np.uint64)
    out[1:] = np.where(words.rows[1:] == words.rows[:-1], hashes[:-1], 0)
    return out


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and more, estimated from how many counts are 1, 2, 3 and 4 (modified Kneser-Ney)."""
    n = np.bincount(np.minimum(counts, 5), minlength=6).astype(float)
    out = np.array([0.0, 0.5, 1.0, 1.5])  # where there are too few counts to estimate from
    if n[1] and n[2]:
        y = n[1] / (n[1] + 2 * n[2])
        for k in (1, 2, 3):
            if n[k] and n[k + 1]:
                out[k] = np.clip(k - (k + 1) * y * n[k + 1] / n[k], 0.1 * k, k)
    return out


def backed_off(counts: np.ndarray, where: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(discounted share of each event within its context, the mass that each context leaves to the order below: 1 if it is empty)."""
    taken = off[np.minimum(counts, 3)]
    total = np.bincount(where, counts)
    rest = np.where(total > 0, np.bincount(where, taken) / np.maximum(total, 1), 1.0)
    return (counts - taken) / np.maximum(total, 1)[where], np.clip(rest, 1e-3, 1)


class KneserNey:
    """Log-likelihood ratios of words, each after the word before it, between two classes of texts.

    Expressions of two words back off to the word in the class, whose likelihood is that of the steps of its path; each
    step backs off to counts that both classes share.
    """

    def __init__(self, classes: list[list[tuple[np.ndarray, np.ndarray]]]) -> None:
        """``classes``: ordinary and toxic; of each, (paths, words before) of its chunks."""
        tokens = [(np.concatenate([p for p, _ in own], axis=1), np.concatenate([c for _, c in own])) for own in classes]
        pairs, bigrams = [], []
        for path, context in tokens:
            key, first, n = np.unique(mix(context * _PAIR + path[-1]), return_index=True, return_counts=True)
            pairs.append((path[:, first], context[first]))
            bigrams.append((key, n))
        self._steps(pairs)
        self._expressions(pairs, bigrams)

    def _steps(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Of each step of a word's path its ratio, and of each place where paths part that of what is left for others."""
        self.levels = []
        self.word = [np.zeros(t[0].shape[1]) for t in texts]  # ln P(word) in the class, of each class's pairs
        cross = [np.zeros(t[0].shape[1]) for t in texts]  # and in the other class
        parents = [np.zeros(t[0].shape[1], np.uint64) for t in texts]
        for k in range(len(PREFIXES) + 1):
            counts = []
            for (path, context), parent in zip(texts, parents, strict=True):
                # How many different words stand before this step.
                _, first = np.unique(mix(context * _PAIR + path[k]), return_index=True)
                node, at, n = np.unique(path[k][first], return_index=True, return_counts=True)
                counts.append((node, parent[first][at], n))
            nodes, at = np.unique(np.concatenate([c[0] for c in counts]), return_index=True)
            over = np.concatenate([c[1] for c in counts])[at]
            up, where = np.unique(over, return_inverse=True)
            n = [_lookup(c[0], c[2], nodes) for c in counts]
            shared = (n[0] + n[1]) / np.bincount(where, n[0] + n[1])[where]
            logs, rest = [], []
            for own in n:
                share, left = backed_off(own, where, discounts(own[own > 0]))
                logs.append(np.log(share + left[where] * shared))
                rest.append(np.log(left))
            # Rare steps say what unknown ones say.
            more, split = n[0] + n[1] >= STEP_LEAST, np.bincount(where, n[0] + n[1]) >= STEP_LEAST
            self.levels.append((nodes[more], (logs[1] - logs[0])[more], up[split], (rest[1] - rest[0])[split]))
            for c, (path, _) in enumerate(texts):
                at = np.searchsorted(nodes, path[k])
                self.word[c] += logs[c][at]
                cross[c] += logs[1 - c][at]
            parents = [t[0][k] for t in texts]
        self.word = [np.stack((self.word[0], cross[0])), np.stack((cross[1], self.word[1]))]

    def _expressions(self, texts: list[tuple[np.ndarray, np.ndarray]], bigrams: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Of each expression met twice or more its ratio, and of each word that of what it leaves to the order below."""
        key, at = np.unique(np.concatenate([k for k, _ in bigrams]), return_index=True)
        before, word = np.concatenate([c for _, c in texts])[at], np.concatenate(self.word, axis=1)[:, at]
        del self.word
        up, where = np.unique(before, return_inverse=True)
        n = [_lookup(*b, key) for b in bigrams]
        logs, rest = [], []
        for own, below in zip(n, word, strict=True):
            share, left = backed_off(own, where, discounts(own[own > 0]))
            logs.append(np.log(share + left[where] * np.exp(below)))
            rest.append(np.log(left))
        more, often = n[0] + n[1] >= LEAST, np.bincount(where, n[0] + n[1]) >= LEAST
        self.pairs = (key[more], (logs[1] - logs[0])[more])
        self.left = (up[often], (rest[1] - rest[0])[often])
        self.met = np.zeros(1 << 20, bool)
        self.met[(self.pairs[0] >> np.uint64(44)).astype(np.int64)] = True

    def ratios(self, path: np.ndarray) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary): the sum over the steps of its path."""
        out = np.zeros(path.shape[1])
        parent, left = np.zeros(path.shape[1], np.uint64), np.arange(path.shape[1])
        for step, (nodes, ratio, up, rest) in zip(path, self.levels, strict=True):
            at = np.minimum(np.searchsorted(nodes, step[left]), max(0, len(nodes) - 1))
            known = nodes[at] == step[left] if len(nodes) else np.zeros(len(left), bool)
            out[left[known]] += ratio[at[known]]
            new = left[~known]  # an unknown step has only the shared mass; below it nothing is known
            out[new] += _lookup(up, rest, parent[new])
            left = left[known]
            parent = step
        return out

    def each(self, words: Words) -> np.ndarray:
        """Of each word: log P(word | word before, toxic) - log P(word | word before, ordinary)."""
        hashes = words.hashes()
        first, kind = words.distinct()
        starts, stops = words.starts, words.ends
        words.starts, words.ends = starts[first], stops[first]
        alone = self.ratios(paths(words))
        words.starts, words.ends = starts, stops
        context = before(words, hashes)
        kinds = _lookup(*self.left, hashes[first])
        out = alone[kind]
        out[1:] += np.where(context[1:] != 0, kinds[kind[:-1]], 0.0)
        out[context == 0] += _lookup(*self.left, np.zeros(1, np.uint64))[0]
        pair = mix(context * _PAIR + hashes)
        maybe = np.flatnonzero(self.met[(pair >> np.uint64(44)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.pairs[0], pair[maybe]), len(self.pairs[0]) - 1)
            known = self.pairs[0][at] == pair[maybe]
            out[maybe[known]] = self.pairs[1][at[known]]
        return out

    def features(self, words: Words) -> np.ndarray:
        """Per text the difference of its log-likelihoods over its length, and the largest over passages of each size."""
        n = len(words.offsets) - 1
        out = np.zeros((n, 1 + len(WINDOWS)))
        if not len(words):
            return out
        sums = np.concatenate(([0.0], np.cumsum(self.each(words))))
        ends = np.cumsum(words.per_row)
        full = np.flatnonzero(words.per_row)
        begins = ends[full] - words.per_row[full]
        out[full, 0] = (sums[ends[full]] - sums[begins]) / words.per_row[full]
        place, end = np.arange(len(words)), ends[words.rows]
        for k, size in enumerate(WINDOWS):
            out[full, 1 + k] = np.maximum.reduceat(sums[np.minimum(place + size, end)] - sums[:-1], begins) / size
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic curve, the constant last, by Newton's method."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(batches: Iterator[pa.RecordBatch], priors: dict[int, float]) -> bytes | None:
    """A pickled (model, curve) from rows (text, toxic, part): parts 0 and 1 give the counts, part 2 the curve."""
    counted: list[list] = [[], []]
    seen: list[set[bytes]] = [set(), set()]
    later: list[pa.RecordBatch] = []
    for b in chunks(batches, "t"):
        toxic, part = np.asarray(b.column(1)), np.asarray(b.column(2))
        later.append(b.filter(pa.array(part == 2)))
        for c in (0, 1):
            own = b.filter(pa.array((part < 2) & (toxic == c)))
            new = []
            for t in own.column(0).to_pylist():
                new.append((digest := xxhash.xxh3_128_digest(t)) not in seen[c])
                seen[c].add(digest)
            own = own.filter(pa.array(new, pa.bool_()))
            if own.num_rows:
                words = Words(*buffers(own.column(0)), ALNUM)
                path = paths(words)
                counted[c].append((path, before(words, path[-1])))
    if not all(counted):
        return None
    model = KneserNey(counted)
    x, y = [np.zeros((0, 1 + len(WINDOWS)))], [np.zeros(0)]
    for b in later:
        if b.num_rows:
            x.append(model.features(Words(*buffers(b.column(0)), ALNUM)))
            y.append(np.asarray(b.column(1)).astype(float))
    x, y = np.concatenate(x), np.concatenate(y)
    if not 0 < y.sum() < len(y):
        return None
    weight = np.where(y == 1, priors[1] / y.sum(), priors[0] / (len(y) - y.sum())) * len(y)
    return pickle.dumps((model, fit_logistic(x, y, weight)))


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic, part) of a bounded sample, and the share of each class among all usable labels."""
    rows = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull() & usable)
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    dealt = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(4)), F.lit(1_000_000))
    share = F.when(F.col("toxic") == 1, F.lit(SAMPLE[1] / max(1, counts.get(1, 0)))).otherwise(F.lit(SAMPLE[0] / max(1, counts.get(0, 0))))
    # At most about SAMPLE rows are left, whatever the size of the tables.
    chosen = F.broadcast(rows.where(dealt < share * 1_000_000).select("_id", "toxic", F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(5)), F.lit(3)).cast("int").alias("part")))
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).join(chosen, "_id").select(F.coalesce("t", F.lit("")).alias("t"), "toxic", "part")
    total = max(1, sum(counts.values()))
    return sample, {c: counts.get(c, 0) / total for c in (0, 1)}


def scored(docs: DataFrame, labels: DataFrame, learnt: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a last column ``score`` (with underscores behind it if there is such a column).

    ``learnt``: a condition on ``_id``, of the labels to learn from.
    """
    spark = docs.sparkSession
    sample, priors = labelled_sample(docs, labels, learnt if learnt is not None else F.lit(True), id_col, text_col)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        got = train(batches, priors)
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([got], pa.binary())], ["model"])

    models = sample.repartition(1).mapInArrow(fit, "model binary").collect()  # one row, bounded like the sample
    book = spark.sparkContext.broadcast(pickle.loads(models[0].model) if models else None)
    del models
    at, name = docs.columns.index(text_col), fresh("score", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        model, curve = book.value or (None, None)
        for b in chunks(batches, text_col):
            if model is None:
                scores = np.zeros(b.num_rows)
            else:
                x = model.features(Words(*buffers(b.column(at)), ALNUM)) @ curve[:-1] + curve[-1]
                scores = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted. ``held_out``: from an id column's name, the rows whose labels are not to be learnt from."""
    held = (lambda c: F.coalesce(held_out(c), F.lit(False))) if held_out is not None else (lambda c: F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return scored(rows, labels, ~held("_id")).select("doc_id", held("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
