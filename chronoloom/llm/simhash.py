"""SimHash near-duplicates with Golay-code fuzzy hashing.

Fingerprints of 64 bits link where at most four bits differ. A fingerprint is cut into three segments of at
most 23 bits, and each segment is decoded with the perfect (23, 12) Golay code: every vector is within three
bits of exactly one codeword. The keys of a segment are the indices of all codewords within four bits: one
where the nearest is within two bits, else six. Two vectors that differ in at most two bits share a key,
because some vector lies within one bit of both and its nearest codeword is within four bits of either.

Four differing bits over three segments leave two cases (pigeonhole): no segment has over two of them, so a
key of each of the three segments is shared (36 bits together); or one has three or four, so of the other two
one is equal and one differs in at most one bit, and the equal segment with a key of the other is shared (33
bits or more). Both kinds of key are joined, and every candidate is verified on its bits, so links are exact.

Nulls: null and empty texts have fingerprint zero and link like any other. A null id never names a component
unless all its documents lack one; an id that is not a whole number is an error. A very long text is hashed whole. An empty
table gives an empty result. Only the id and text columns are read, whatever the others' names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, kept, mix, uncut, whole_id

BITS = 4
SHINGLE = 4
SEED = 42
#: Bits of the three segments; each is filled up with zeros to the code's 23.
SEGMENTS = (22, 21, 21)
#: Buckets above this many fingerprints are linked by spreading from one to the next instead of by pairs.
PAIRWISE = 64


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included; of fewer words, that of the whole sequence."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    return np.fromiter((digest(line[a:z], SEED) for a, z in spans), np.uint64, n)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("simhash")
        for b in chunks(batches, "t"):
            fps = np.array([fingerprint(shingle_hashes(t, size)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(whole_id(docs, id_col).alias("d"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


class Golay:
    """Decoding tables of the (23, 12) code with generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1."""

    GENERATOR = 0b101011100011

    def __init__(self) -> None:
        low = np.arange(1 << 12, dtype=np.int64)
        self.low, self.high = self._remainder(low), self._remainder(low << 11)
        leader = np.zeros(1 << 11, np.int64)
        self.near = np.zeros(1 << 11, bool)  # the nearest codeword is within two bits
        self.near[0] = True
        for weight in (1, 2, 3):
            errors = np.array([sum(1 << p for p in c) for c in combinations(range(23), weight)])
            s = self.syndrome(errors)
            leader[s], self.near[s] = errors, weight < 3
        self.leader = leader
        words = low << 11
        words = words | self.high[low]
        sevens = words[np.bitwise_count(words) == 7]
        # Codewords four bits away are those of weight seven that hold the three bits of the error.
        self.others = np.zeros((1 << 11, 5), np.int64)
        for s in np.flatnonzero(~self.near):
            self.others[s] = sevens[(sevens & leader[s]) == leader[s]] >> 11

    def _remainder(self, v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for bit in range(22, 10, -1):
            v ^= ((v >> bit) & 1) * (self.GENERATOR << (bit - 11))
        return v

    def syndrome(self, v: np.ndarray) -> np.ndarray:
        return self.high[v >> 11] ^ self.low[v & 0x7FF]

    def keys(self, v: np.ndarray) -> np.ndarray:
        """Indices of the codewords within four bits: six columns, -1 in the last five where there is one."""
        s = self.syndrome(v)
        nearest = (v ^ self.leader[s]) >> 11
        others = np.where(self.near[s][:, None], -1, nearest[:, None] ^ self.others[s])
        return np.concatenate((nearest[:, None], others), axis=1)


_golay: Golay | None = None


def golay() -> Golay:
    global _golay
    if _golay is None:
        _golay = Golay()
    return _golay


def candidate_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the fingerprint) for all keys of all fingerprints."""
    fps = fps.astype(np.uint64)
    parts, shift = [], 64
    for n in SEGMENTS:
        shift -= n
        parts.append(((fps >> np.uint64(shift)) & np.uint64((1 << n) - 1)).astype(np.int64))
    own = [golay().keys(p) for p in parts]
    keys, rows = [], []
    a, b, c = own
    for i in range(6):
        for j in range(6):
            pair = np.where((a[:, i] >= 0) & (b[:, j] >= 0), a[:, i] << 12 | b[:, j], -1)
            for k in range(6):
                at = np.flatnonzero((pair >= 0) & (c[:, k] >= 0))
                keys.append(pair[at] << 12 | c[at, k])
                rows.append(at)
    for x in range(3):
        for y in range(3):
            for k in range(6 if x != y else 0):
                at = np.flatnonzero(own[y][:, k] >= 0)
                keys.append((1 + 3 * x + y) << 40 | parts[x][at] << 12 | own[y][at, k])
                rows.append(at)
    return mix(np.concatenate(keys).astype(np.uint64)).view(np.int64), np.concatenate(rows)


class Forest:
    """Union-find over what one task links; the smallest member is the root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, top = self.parent, x
        while (p := parent.get(top, top)) != top:
            top = p
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def link(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def link_bucket(fps: np.ndarray, forest: Forest, bits: int) -> None:
    """Link all members of one bucket that are connected in it. Memory is that of the bucket."""
    left = fps
    while len(left):
        seeds, left = [left[0]], left[1:]
        while seeds and len(left):
            seed = seeds.pop()
            close = np.bitwise_count(left ^ seed) <= bits
            if close.any():
                for x in left[close].tolist():
                    forest.link(int(seed), x)
                seeds.extend(left[close])
                left = left[~close]


def links(keys: DataFrame, bits: int = BITS) -> DataFrame:
    """(node, root): a spanning forest of the links that each task sees. Rows must come by key, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("simhash")
        forest = Forest()
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def work(k: np.ndarray, f: np.ndarray) -> None:
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            size = np.diff(np.append(first, len(k)))
            for at, n in zip(first[size > PAIRWISE].tolist(), size[size > PAIRWISE].tolist(), strict=True):
                link_bucket(f[at : at + n], forest, bits)
            small = size <= PAIRWISE
            left = np.repeat(np.where(small, size, 0), size) - np.where(np.repeat(small, size), np.arange(len(k)) - np.repeat(first, size), 0) - 1
            step, at = 1, np.flatnonzero(left >= 1)
            found = []
            while len(at):
                x, y = f[at], f[at + step]
                close = np.bitwise_count(x ^ y) <= bits
                found.append(np.stack((np.minimum(x[close], y[close]), np.maximum(x[close], y[close])), axis=1))
                step += 1
                at = at[left[at] >= step]
            if found:
                x, y = np.concatenate(found).T
                order = np.lexsort((y, x))
                x, y = x[order], y[order]
                new = np.ones(len(x), bool)
                new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                for a, z in zip(x[new].tolist(), y[new].tolist(), strict=True):
                    forest.link(a, z)

        for b in batches:
            k = np.concatenate((rest_k, np.asarray(b.column(0))))
            f = np.concatenate((rest_f, np.asarray(b.column(1)).view(np.uint64)))
            whole = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if whole:
                work(k[:whole], f[:whole])
            rest_k, rest_f = k[whole:], f[whole:]
        if len(rest_k):
            work(rest_k, rest_f)
        nodes = np.fromiter(forest.parent, np.uint64, len(forest.parent))
        roots = np.fromiter((forest.find(x) for x in nodes.tolist()), np.uint64, len(nodes))
        for at in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)].view(np.int64)) for x in (nodes, roots)], ["node", "root"])

    return keys.mapInArrow(run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (node, root), by hooking to the least neighbour and contracting.

    Each round is a few aggregations and joins over what is left of the edges and is written to the shared
    folder; nothing but a count comes to the driver. Minima combine before the shuffle, and joins on a hub's
    key are plain equi-joins, which adaptive execution splits.
    """
    edges = cut(edges.where("node != root").distinct(), "edges")
    done = None
    while not edges.isEmpty():
        both = edges.select("node", "root").union(edges.select(F.col("root"), F.col("node")))
        hooks = cut(both.groupBy("node").agg(F.min("root").alias("_r")).select("node", F.least("node", "_r").alias("root")), "hooks")
        while True:  # halve the paths until all lead to a root
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = cut(hooks.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "hooks")
            uncut(hooks)
            hooks = jumped
            if jumped.where("moved").isEmpty():
                break
        more = hooks.select("node", "root")
        if done is not None:
            more = done.join(hooks.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = cut(more, "roots")
        to = lambda name: hooks.select(F.col("node").alias(name), F.col("root").alias(f"_{name}"))
        rest = cut(edges.join(to("node"), "node").join(to("root"), "root").select(F.col("_node").alias("node"), F.col("_root").alias("root")).where("node != root").distinct(), "edges")
        uncut(edges, hooks, done)
        edges, done = rest, roots
    return done if done is not None else edges


def simhash_components(docs: DataFrame, size: int = SHINGLE, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for each document. ``bits`` is at most four, which the keys cover."""
    if bits > BITS:
        raise ValueError(f"the keys find links of at most {BITS} bits")
    fps = cut(fingerprints(docs, size, id_col, text_col), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("label"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("simhash")
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                own = np.asarray(b.column(0).slice(at, 2048)).view(np.uint64)
                k, rows = candidate_keys(own)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(own[rows].view(np.int64))], ["key", "fp"])

    keys = distinct.select("fp").mapInArrow(explode, "key long, fp long")
    # A key that few hold is a small bucket; equal fingerprints are one row by now.
    roots = components(links(keys.repartition("key").sortWithinPartitions("key", "fp"), bits))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "label", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("label").alias("component_id"))
    members = named.join(least, "root").select("fp", "component_id")
    return fps.join(members, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Tables of the similarity search, each keyed by the Golay keys of two segments of 23 bits.
TABLES = 12
WORDS = 9
#: Words of the fingerprint that travel with a key; at two of them unrelated texts are practically never taken for close.
CARRIED = 2
#: Cells by which shingles are counted: two sets share at most the sum of the lesser counts.
CELLS = 128
#: Keys that one task works on at a time, about.
KEYS_AT_ONCE = 4_000_000


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """576 bits: the SimHash of the hashes, then those of their remixes."""
    out, h = b"", hashes
    for k in range(WORDS):
        out += fingerprint(h).to_bytes(8, "little")
        h = mix(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return out


def table_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) for all tables: 4 bits of table, and the 12-bit codeword indices of its two segments."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")[:, : 2 * TABLES * 23]
    segments = bits.reshape(len(words), 2 * TABLES, 23) @ (1 << np.arange(23, dtype=np.int64))
    keys, rows = [], []
    for t in range(TABLES):
        a, b = golay().keys(segments[:, 2 * t]), golay().keys(segments[:, 2 * t + 1])
        for i in range(6):
            for j in range(6):
                at = np.flatnonzero((a[:, i] >= 0) & (b[:, j] >= 0))
                keys.append((t << 24 | a[at, i] << 12 | b[at, j]).astype(np.int32))
                rows.append(at)
    return np.concatenate(keys), np.concatenate(rows)


def equal_sets(texts: list, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    return [np.unique(shingle_hashes(t, size)) for t in texts]


def _steps(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same bucket, of all buckets at once."""
    at = np.repeat(first, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    left = np.repeat(first + size, size) - at - 1
    step = 1
    while (live := left >= step).any():
        at, left = at[live], left[live]
        yield at, at + step
        step += 1


def centre(fps: np.ndarray) -> int:
    """The fingerprint (a row of words) nearest to the bits that most of them have."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1)
    return int((bits != (2 * bits.sum(axis=0, dtype=np.int64) > len(bits))).sum(axis=1).argmin())


def neighbours(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, partner, weight, open): a row for each node that shares a key with a close one, that differs in at most ``bits`` bits.

    The partner is the close one that is central to most; the weight says to how many. A node is open if it may have
    further ones. Buckets up to ``PAIRWISE`` are compared in pairs. In a larger one every member is open, and its
    partner is the bucket's centre.
    """
    order = np.lexsort((nodes, keys))
    keys, nodes, fps = keys[order], nodes[order], fps[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(keys)))
    small, large = (size > 1) & (size <= PAIRWISE), size > PAIRWISE
    xs, zs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, z in _steps(first[small], size[small]):
        near = np.bitwise_count(fps[a] ^ fps[z]).sum(axis=1) <= bits
        xs.append(a[near])
        zs.append(z[near])
    a, z = np.concatenate(xs), np.concatenate(zs)
    x, y = np.concatenate((a, z)), np.concatenate((z, a))
    weight = np.bincount(x, minlength=len(nodes))[y]
    x, y = [nodes[x]], [nodes[y]]
    weight, more = [weight], [np.zeros(len(weight), bool)]
    for at, n in zip(first[large].tolist(), size[large].tolist(), strict=True):
        x.append(nodes[at : at + n])
        y.append(np.full(n, nodes[at + centre(fps[at : at + n])]))
        weight.append(np.full(n, n))
        more.append(np.ones(n, bool))
    x, y, weight, more = (np.concatenate(v) for v in (x, y, weight, more))
    order = np.lexsort((y, -weight, x))
    x, y, weight, more = x[order], y[order], weight[order], more[order]
    if not len(x):
        return x, y, weight, more
    begin = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    more = np.logical_or.reduceat(more, begin) | (np.minimum.reduceat(y, begin) != np.maximum.reduceat(y, begin))
    return x[begin], y[begin], weight[begin], more


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id, linking documents whose sets of word shingles have a Jaccard similarity of ``similarity`` or more."""
    return near_groups(docs, size, similarity, id_col, text_col).select("doc_id", "component_id")


def near_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_md5 and component_id for each row; rows of equal id but other text may be in different components.

    At a similarity of 0.8 some 15 % of the bits of two fingerprints differ, too many for the exact search above. So
    fingerprints of the distinct shingles have 576 bits, and ``TABLES`` tables are each keyed by the Golay keys of two
    segments; a pair at 0.8 shares a key in one of them at least with a probability of about 0.99 (a segment's keys meet
    in 60 % of such pairs), and more so above. Links are decided on the shingles themselves. Texts with the same set of
    shingles are one node.

    Pairs are never listed by bucket. Each node that has close ones in its buckets is first verified with three of
    them: the one that is central to most, which links most of a group to its centre, and the least and the greatest,
    which link groups. A node with a single close one is done with that. All others are open, and open nodes of different components are joined on their rarest shingles: of
    two sets with the similarity, the rarest 20 % of one must meet those of the other, at places that leave room for enough
    common ones (prefix and position filters, which lose nothing). What passes is verified like the rest. So no
    bucket's size matters for the result, and a group of near copies or texts of one template costs about its size.
    """
    spark = docs.sparkSession
    # Bits that may differ at the similarity, with four standard deviations.
    p, n_bits = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi), 64 * CARRIED
    most = int(n_bits * p + 4 * (n_bits * p * (1 - p)) ** 0.5)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("simhash")
        for b in chunks(batches, "t"):
            sets = equal_sets(b.column(1).to_pylist(), size)
            cells = [[xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [wide_fingerprint(s) for s in sets]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, pa.binary()) for c in cells)], ["doc_id", "text_md5", "set", "bits"])

    rows = docs.select(whole_id(docs, id_col).alias("d"), F.col(text_col).alias("t"), text_md5(text_col).alias("m"))
    sketches = cut(rows.mapInArrow(sketch, "doc_id long, text_md5 binary, set binary, bits binary"), "sketches")
    nodes = sketches.groupBy("set").agg(F.min(F.struct("text_md5", "bits")).alias("x"), F.min("doc_id").alias("label"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "set", "label", F.col("x.text_md5").alias("first"), F.col("x.bits").alias("bits")), "nodes")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, nodes.count() * TABLES * 30 // KEYS_AT_ONCE)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bits, node) to packed keys by part; members are (node, carried words)."""
        kept("simhash")
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                part = b.slice(a, 2048)
                words = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint64).reshape(-1, WORDS)
                members = np.concatenate((np.asarray(part.column(1))[:, None], words[:, :CARRIED].view(np.int64)), axis=1)
                keys, at = table_keys(words)
                # By table and first segment, so that a node goes to few parts.
                to = (mix(keys.astype(np.uint64) >> np.uint64(12)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                keys, at, ends = keys[order], at[order], np.cumsum(np.bincount(to, minlength=parts))
                full = np.flatnonzero(np.diff(ends, prepend=0))
                cells: list[list[bytes]] = [[], [], []]
                for k in full.tolist():
                    x, z = int(ends[k - 1]) if k else 0, int(ends[k])
                    own, place = np.unique(at[x:z], return_inverse=True)
                    for c, v in zip(cells, (keys[x:z], place.astype(np.uint16), members[own]), strict=True):
                        c.append(v.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(full), *(pa.array(c, pa.binary()) for c in cells)], ["part", "keys", "at", "members"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by part to ``neighbours``, one part in memory at a time."""
        kept("simhash")
        for _, blobs in groupby((x for b in batches for x in zip(*(b.column(n).to_pylist() for n in range(4)), strict=True)), lambda x: x[0]):
            keys, at, members, n = [], [], [], 0
            for _, k, a, m in blobs:
                keys.append(np.frombuffer(k, np.int32))
                at.append(np.frombuffer(a, np.uint16).astype(np.int32) + n)
                members.append(np.frombuffer(m, np.int64).reshape(-1, 1 + CARRIED))
                n += len(members[-1])
            own = np.concatenate(members)[np.concatenate(at)]
            found = neighbours(np.concatenate(keys), own[:, 0], own[:, 1:].view(np.uint64), most)
            for a in range(0, len(found[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(v[a : a + (1 << 16)]) for v in found], ["node", "partner", "weight", "open"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("simhash")
        for b in chunks(batches, "t"):
            sets = equal_sets(b.column(1).to_pylist(), size)
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            counts = np.bincount(np.repeat(np.arange(len(sets)), np.diff(ends)) * CELLS + (flat & (CELLS - 1)), minlength=len(sets) * CELLS)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * CELLS, pa.int32()), pa.array(counts, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), cells], ["node", "shingles", "cells"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for k in range(b.num_rows):
                x, y = (np.asarray(b.column(c)[k].values) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["node", "root"]).filter(pa.array(keep, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda c, s: sets.select(F.col("node").alias(c), F.col("shingles").alias(s))
        both = pairs.join(side("node", "x"), "node").join(side("root", "y"), "root").select("node", "root", "x", "y")
        return both.mapInArrow(similar, "node long, root long")

    # A text without words has no shingles, and no other text is compared with it.
    worded = nodes.where(F.col("set") != F.lit(bytearray(xxhash.xxh3_128_digest(b""))))
    blobs = worded.select("bits", "node").mapInArrow(explode, "part long, keys binary, at binary, members binary")
    met = blobs.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(pair, "node long, partner long, weight long, open boolean")
    best = F.max_by("partner", F.struct("weight", -F.col("partner")))
    low, high = F.min("partner"), F.max("partner")
    near = cut(met.groupBy("node").agg(F.array(best, low, high).alias("partners"), (F.max("open") | (low != high)).alias("open")), "near")
    wanted = near.select("node").join(nodes.select("node", "first"), "node")
    sets = cut(rows.join(wanted, F.col("m") == F.col("first")).select("node", "t").mapInArrow(shingles, "node long, shingles array<long>, cells array<int>").dropDuplicates(["node"]), "shingles")

    partners = near.select("node", F.explode("partners").alias("partner")).where("node != partner")
    pairs = partners.select(F.greatest("node", "partner").alias("node"), F.least("node", "partner").alias("root")).distinct()
    roots = components(verified(pairs))
    left = near.where("open").select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    roots = components(roots.unionByName(verified(cut(prefix_pairs(left.join(sets, "node"), similarity), "pairs"))))
    named = nodes.select("node", "set", "label").join(roots, "node", "left").select("set", "label", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("label").alias("component_id"))
    return sketches.select("doc_id", "text_md5", "set").join(named.join(least, "root").select("set", "component_id"), "set").select("doc_id", "text_md5", "component_id")


def prefix_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """(node, root): pairs of nodes of different roots that may have the similarity, from (node, root, shingles, cells). None is lost.

    In the order of all shingles by how many nodes have them, two sets of n and m shingles with the similarity t have
    t / (1 + t) * (n + m) in common, so the first that they share is at most that far from either's end, and among the
    first n - t * n + 1 of each. Shingles of one node only come first in that order and are not listed. Nor can two sets share
    more than the sum of the lesser of their counts, cell by cell.
    """
    share = similarity / (1 + similarity)
    whole = lambda c: F.ceil(c - F.lit(1e-9)).cast("int")
    each = members.select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("e"))
    cells = members.select("node", "cells")
    counts = each.groupBy("e").agg(F.count(F.lit(1)).alias("c"), (F.min("root") != F.max("root")).alias("live")).where("c > 1")
    own = F.array_sort(F.collect_list(F.struct("c", "e", "live"))).alias("own")
    listed = each.join(counts, "e").groupBy("node", "root", "n").agg(own).withColumn("alone", F.col("n") - F.size("own"))
    prefix = F.slice("own", F.lit(1), F.greatest(F.lit(0), F.col("n") - whole(F.col("n") * similarity) + 1 - F.col("alone")))
    places = cut(listed.select("node", "root", "n", "alone", F.posexplode(prefix).alias("k", "x")).where("x.live").select("node", "root", "n", (F.col("alone") + F.col("k")).alias("at"), "x.e"), "prefixes")
    places = places.join(cells, "node").select("node", "root", "n", "at", "e", "cells")
    short = places.where(F.col("n") - F.col("at") >= whole(F.col("n") * 2 * share)).toDF("a", "ra", "na", "ata", "e", "ca")
    long = places.toDF("b", "rb", "nb", "atb", "e", "cb")
    wanted = whole((F.col("na") + F.col("nb")) * share)
    room = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= wanted
    common = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y) >= wanted
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = short.join(long, (short["e"] == long["e"]) & (F.col("ra") != F.col("rb")) & ordered & room & common)
    return met.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()


def text_md5(col: str | Column) -> Column:
    """16 bytes; a null text counts as an empty one."""
    text = F.col(col) if isinstance(col, str) else col
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
