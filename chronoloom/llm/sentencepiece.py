"""SentencePiece encoding and decoding over an Aho-Corasick automaton.

An Aho-Corasick automaton over all pieces runs once over the text; at each position its output links give the
pieces that end there, and each of them relaxes the best entry of that position from the entry of the position
at which it begins (Viterbi). What "best" means is the model's:

- unigram models: the greatest sum of piece scores;
- BPE models: the library does not maximise a sum there but merges by rank, so an entry is extended by a piece
  only if merging would leave the boundary between the entry's last piece and the new one alone. Exactly one piece passes
  at each position that can be reached, and the path that ends at the last one is the library's result.

Text is worked on in stretches that no piece crosses: white space is only ever the start of a piece. Distinct
stretches are encoded once per worker and remembered in a bounded table, all of a batch in step. Characters
without a piece become byte pieces if the model has these, else the unknown id. Decoding puts the pieces' bytes
together and takes off the blank that encoding puts in front.

Nulls: a null or empty text has no ids. U+2581 is the model's sign for a blank and comes back as one; all other
texts come back byte for byte. Repeated rows and empty tables need no care. Long stretches without white space, and runs of
blanks, take time in proportion to their length. Other columns than the named ones are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, Words, buffers, chunks, kept, trim

BLANK = "▁"
REMEMBERED = 300_000
#: Bytes of text that are encoded at a time; less than elsewhere, as pieces and their bytes take more room than text.
AT_ONCE = 1 << 20
#: Stretches up to this many characters are encoded together, in step; longer ones one by one.
TOGETHER = 48
_AS_IS = np.arange(256, dtype=np.uint8)
_NEVER = np.int64(1) << 60


class Pieces:
    """What encoding needs of a model file: pieces, scores, kinds, and for BPE how pieces are merged."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if len(spec.precompiled_charsmap) or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models that leave texts as they are, with a blank in front, are read")
        self.bpe = proto.trainer_spec.model_type == 2
        kinds = np.array([p.type for p in proto.pieces])
        self.names = [p.piece for p in proto.pieces]
        self.scores = np.array([p.score for p in proto.pieces])
        self.unknown = int(np.flatnonzero(kinds == 2)[0])
        self.bytes = np.full(256, -1, np.int64)
        for k in np.flatnonzero(kinds == 6).tolist():
            self.bytes[int(self.names[k][3:5], 16)] = k
        normal = np.flatnonzero((kinds == 1) | (kinds == 4)).tolist()
        self.number = {self.names[k]: k for k in normal}
        if any(BLANK in p.lstrip(BLANK) for p in self.number):
            raise ValueError("a piece goes on after a blank")
        self.one_line = any("\n" in p for p in self.number)
        #: Bytes of each piece in decoded text.
        self.decoded = [p.replace(BLANK, " ").encode() if k in (1, 4) else bytes([int(p[3:5], 16)]) if k == 6 else " ⁇ ".encode() if k == 2 else b"" for p, k in zip(self.names, kinds.tolist(), strict=True)]
        if self.bpe:
            self._merges()

    def _merges(self) -> None:
        """rank: order of merging (-1: a single character); left, right: what a piece was merged from; pairs of pieces that make one."""
        n = len(self.names)
        order = sorted(self.number.values(), key=lambda k: (-self.scores[k], k))
        self.rank = np.full(n, -1, np.int64)
        for r, k in enumerate(order):
            if len(self.names[k]) > 1:
                self.rank[k] = r
        keys, made = [], []
        for p, k in self.number.items():
            for cut in range(1, len(p)):
                if (a := self.number.get(p[:cut])) is not None and (b := self.number.get(p[cut:])) is not None:
                    keys.append(a * n + b)
                    made.append(int(self.rank[k]))
        by = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[by], np.array(made, np.int64)[by]
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.whole = np.zeros(n, bool)  # merging the piece's own text ends in the piece
        for p, k in self.number.items():
            last = self.merge(p, history=True)
            if len(p) == 1:
                self.whole[k] = True
            elif last and last[0] == 1:
                self.whole[k], self.left[k], self.right[k] = True, last[1], last[2]

    def merge(self, text: str, history: bool = False):
        """BPE by its definition: ever the pair of the best rank, the leftmost of equals. For short or odd texts."""
        number, names = self.number, self.names
        symbols = [number.get(c, c) for c in text]
        while True:
            best = None
            for i in range(len(symbols) - 1):
                a, b = symbols[i], symbols[i + 1]
                if isinstance(a, int) and isinstance(b, int) and (k := number.get(names[a] + names[b])) is not None and (best is None or self.scores[k] > best[0]):
                    best = (self.scores[k], i, k)
            if best is None:
                return None if history else [x for s in symbols for x in ([s] if isinstance(s, int) else self.spelt(s))]
            _, i, k = best
            if history and len(symbols) == 2:
                return 1, symbols[0], symbols[1]
            symbols[i : i + 2] = [k]

    def spelt(self, char: str) -> list[int]:
        ids = self.bytes[list(char.encode())]
        return [self.unknown] if (ids < 0).any() else ids.tolist()

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the texts of pieces a and b, side by side, leaves the boundary between them.

        Merges happen in order of rank, so the symbols at the boundary are followed back in time: the later
        made of the two is undone, and at each stage the two must not be a pair that would have been merged before either
        went into what it next became (of equal ranks, the one further left is first).
        """
        out = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        x, y = a[live], b[live]
        end_x, end_y = np.full(len(live), _NEVER), np.full(len(live), _NEVER)
        n = len(self.names)
        while len(live):
            key = x * n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER + 1)
            joined = (rank < end_x) & (rank <= end_y)
            out[live[joined]] = False
            undo_x = self.rank[x] > self.rank[y]
            more = ~joined & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            end_x, end_y = np.where(undo_x, self.rank[x], end_x)[more], np.where(undo_x, end_y, self.rank[y])[more]
            x, y = np.where(undo_x, self.right[x], x)[more], np.where(undo_x, y, self.left[y])[more]
            live = live[more]
        return out


class Encoder(Remembered):
    def __init__(self, pieces: Pieces) -> None:
        super().__init__(REMEMBERED, 1 << 14)
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        usable = pieces.whole if pieces.bpe else np.ones(len(pieces.names), bool)
        for p, k in pieces.number.items():
            if usable[k]:
                self.automaton.add_word(p, k << 16 | len(p))
        self.automaton.make_automaton()
        spelt = [pieces.decoded[k] for k in range(len(pieces.names))]
        self.widths = np.array([*map(len, pieces.names)])
        self.byte_size = np.array([len(x) for x in spelt])
        self.byte_at = np.cumsum(self.byte_size) - self.byte_size
        self.byte_pool = np.frombuffer(b"".join(spelt), np.uint8)
        self.scores = pieces.scores.tolist()
        self.pairs_apart: dict[tuple[int, int], bool] = {}

    def fresh(self, words: list[bytes]) -> list[list[int]]:
        texts = [w.decode().replace(" ", BLANK) for w in words]
        out: list[list[int]] = [[]] * len(texts)
        batch = []
        for k, t in enumerate(texts):
            if self.pieces.bpe and t.startswith(BLANK * 2):
                # Pieces of several blanks all have one rank, below all others: what is left of the blanks is merged last.
                blanks = len(t) - len(t.lstrip(BLANK))
                out[k] = self._blanks(blanks, t[blanks:])
            else:
                batch.append(k)
        short = [k for k in batch if len(texts[k]) <= TOGETHER]
        for k, ids in zip(short, self._viterbi([texts[k] for k in short]), strict=True):
            out[k] = ids
        for k in batch:
            if len(texts[k]) > TOGETHER:
                out[k] = self._single(texts[k])
        return out

    def _single(self, text: str) -> list[int]:
        """One long text, piece by piece as the automaton finds them; what two pieces make of each other is remembered."""
        pieces, n = self.pieces, len(text)
        last, best = [_NEVER] * (n + 1), [-np.inf] * (n + 1)
        best[0] = 0.0
        unknown, scores, bpe, known = float(pieces.scores.min() - 10), self.scores, pieces.bpe, self.pairs_apart
        if len(known) > 2_000_000:
            known.clear()
        found = self.automaton.iter(text)
        match = next(found, None)
        for p in range(n):
            own = []
            while match is not None and match[0] == p:
                own.append((match[1] >> 16, match[1] & 0xFFFF))
                match = next(found, None)
            if not any(length == 1 for _, length in own):
                own.append((-1 - ord(text[p]), 1))
            for k, length in own:
                start = p + 1 - length
                if best[start] == -np.inf:
                    continue
                score = 0.0
                if not bpe:
                    score = best[start] + (scores[k] if k >= 0 else unknown)
                elif start and k >= 0 and (a := last[start]) >= 0:
                    if (good := known.get((a, k))) is None:
                        good = known[a, k] = bool(pieces.apart(np.array([a]), np.array([k]))[0])
                    if not good:
                        continue
                if score >= best[p + 1]:
                    last[p + 1], best[p + 1] = k, score
        out: list[int] = []
        while n:
            k = last[n]
            out += [k] if k >= 0 else reversed(pieces.spelt(chr(-1 - k)))
            n -= int(self.widths[k]) if k >= 0 else 1
        return out[::-1]

    def _blanks(self, n: int, rest: str) -> list[int]:
        if n + len(rest) <= 64:
            return self.pieces.merge(BLANK * n + rest)
        # The last blank joins the word if it joins it alone; the blanks before are merged by themselves.
        tail = self._single(BLANK + rest) if rest else []
        alone = not rest or self.pieces.names[tail[0]] == BLANK
        return self.merge_long(n if alone else n - 1) + (tail[1:] if alone and rest else tail)

    def merge_long(self, n: int) -> list[int]:
        """A run of blanks. All pieces of blanks have one rank, so the leftmost pair that makes a piece is merged first.

        Left of the next blank nothing is left to merge, so only the last two symbols need be looked at: one pass.
        """
        number, symbols = self.pieces.number, []
        joins = {(a, b) for a in range(1, 65) for b in range(1, 65) if BLANK * (a + b) in number}
        for _ in range(n):
            symbols.append(1)
            while len(symbols) > 1 and (symbols[-2], symbols[-1]) in joins:
                symbols[-2:] = [symbols[-2] + symbols[-1]]
        return [number[BLANK * s] for s in symbols]

    def _viterbi(self, texts: list[str]) -> list[list[int]]:
        """All texts in step: position after position, each over the pieces that end there."""
        if not texts:
            return []
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(size + 1) - size - 1
        line = "\0".join(texts)  # no piece holds a NUL, so none is found over a boundary
        end, value = np.fromiter(chain.from_iterable(self.automaton.iter(line)), np.int64).reshape(-1, 2).T
        piece, length = value >> 16, value & 0xFFFF
        text = np.searchsorted(begin, end, "right") - 1
        # Characters that are no piece are entries of their own, numbered below 0.
        chars = np.frombuffer(line.encode("utf-32-le"), np.uint32)
        known = np.zeros(len(chars), bool)
        known[end[length == 1]] = True
        own = np.searchsorted(begin, np.arange(len(chars)), "right") - 1
        odd = np.flatnonzero(~known & (np.arange(len(chars)) < (begin + size)[own]))
        end, text = np.concatenate((end, odd)), np.concatenate((text, own[odd]))
        piece, length = np.concatenate((piece, -1 - chars[odd].astype(np.int64))), np.concatenate((length, np.ones(len(odd), np.int64)))
        place = end - begin[text] + 1
        order = np.argsort(place, kind="stable")
        end, piece, length, text, place = (x[order] for x in (end, piece, length, text, place))
        # Entry e of position p of text t is at begin[t] + t' + p, with one entry more than characters.
        base = begin + np.arange(len(texts))
        last = np.full(int(size.sum()) + 2 * len(texts) + 1, _NEVER)
        best = np.full(len(last), -np.inf)
        best[base] = 0
        steps = np.searchsorted(place, np.arange(1, int(size.max()) + 2))
        bpe = self.pieces.bpe
        unknown = self.pieces.scores.min() - 10
        for a, z in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            k, t = piece[a:z], text[a:z]
            here = base[t] + place[a:z]
            start = here - length[a:z]
            ok = best[start] > -np.inf
            if bpe:
                inner = np.flatnonzero(ok & (place[a:z] > length[a:z]))
                ok[inner] = self.pieces.apart(last[start[inner]], k[inner])
                score = np.zeros(z - a)
            else:
                score = best[start] + np.where(k >= 0, self.pieces.scores[np.maximum(k, 0)], unknown)
            at = np.flatnonzero(ok)
            at = at[np.argsort(score[at], kind="stable")]
            last[here[at]], best[here[at]] = k[at], score[at]
        return self._paths(last, base, size)

    def _paths(self, last: np.ndarray, base: np.ndarray, size: np.ndarray) -> list[list[int]]:
        """The ids on the paths to the ends of all texts, followed back in step."""
        widths = self.widths
        at, live, steps = size.copy(), np.arange(len(size)), []
        while len(live):
            k = last[base[live] + at[live]]
            column = np.full(len(size), _NEVER)
            column[live] = k
            steps.append(column)
            at[live] -= np.where(k >= 0, widths[np.maximum(k, 0)], 1)
            live = live[at[live] > 0]
        table = np.stack(steps[::-1], axis=1)
        there = table != _NEVER
        flat, ends = table[there].tolist(), np.cumsum(there.sum(axis=1)).tolist()
        out = [flat[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
        for t in np.flatnonzero((table < 0).any(axis=1)).tolist():
            out[t] = [x for k in out[t] for x in ([k] if k >= 0 else self.pieces.spelt(chr(-1 - k)))]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all rows, ids in each row, bytes and offsets of the texts with their blank in front)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pc.replace_substring(texts, BLANK, " ")
        front = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ")
        data, offsets = buffers(pc.binary_join_element_wise(front.cast(pa.large_string()), texts, pa.scalar("", pa.large_string())))
        space = data == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        if not self.pieces.one_line:
            line = data == 10
            cut |= line
            cut[1:] |= line[:-1]
        ids, sizes = self.ids(Words(data, offsets, _AS_IS, np.flatnonzero(cut)), data.tobytes())
        return ids, sizes, data, offsets

    def rest(self) -> None:
        """Forget the stretches at a task's end: a worker that waits for other stages must not hold them."""
        self._reset()
        trim()

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts, the blank still in front."""
        n = self.byte_size[ids]
        ends = np.cumsum(n)
        data = self.byte_pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.byte_at[ids] - ends + n, n)]
        return data, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]


def encoder(path: str) -> Encoder:
    return kept(("sentencepiece", path), lambda: Encoder(Pieces(path)))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, and decoded: the text that the ids give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for b in chunks(batches, "t", AT_ONCE):
            ids, sizes, _, _ = own.encode(b.column(1))
            data, offsets = own.decode(ids, sizes)
            raw = data.tobytes()
            texts = [raw[a + 1 : z].decode(errors="replace") if z > a else "" for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
        own.rest()

    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['d']}, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit integers), round_trip: decoding gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for b in chunks(batches, "t", AT_ONCE):
            ids, sizes, data, offsets = own.encode(b.column(1))
            back, places = own.decode(ids, sizes)
            ends = np.cumsum(sizes)
            raw, text, again = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes()), memoryview(back.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            same = [text[a:z] == again[c:d] for a, z, c, d in zip(offsets[:-1].tolist(), offsets[1:].tolist(), places[:-1].tolist(), places[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])
        own.rest()

    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['d']}, n_tokens long, ids_crc32 long, round_trip boolean")
