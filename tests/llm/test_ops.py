"""The corpus operators against brute force, exact round trips and held-out accuracy, with nulls, ties and odd shapes."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from chronoloom.llm import decontaminate, exact_dedup, language, line_dedup, lm_score, queries, sentencepiece, simhash, token_counts, token_ids, toxicity  # noqa: E402
from chronoloom.llm.common import ALNUM, BLANK, Lexicon, Words, buffers, chunks, hash_ranges, id_crc  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t string, score double"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 0.5) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


ODD = ["", None, " ", "\n\n", "a", "A", "a\tb", "a  b", "é ß 日本", "x\x00y", "word " * 5000, "a", None, "the end\r\nof it"]


def test_words_and_hashes():
    a = pa.array(["Ab, cd", None, "", "é1 x", "ab"])
    data, offsets = buffers(a)
    w = Words(data, offsets, ALNUM)
    found = [w.data[x:z].tobytes() for x, z in zip(w.starts, w.ends, strict=True)]
    assert found == [b"ab", b"cd", "é1".encode(), b"x", b"ab"] and w.rows.tolist() == [0, 0, 3, 3, 4]
    ends = np.cumsum([len(x) for x in found])
    alone = hash_ranges(np.frombuffer(b"".join(found), np.uint8), ends - [len(x) for x in found], ends)
    assert w.hashes().tolist() == alone.tolist() and len(set(alone.tolist())) == 4
    assert w.per_row.tolist() == [2, 0, 0, 2, 1]
    sliced = pa.array(["zz", "Ab cd"]).slice(1)
    assert len(Words(*buffers(sliced), BLANK)) == 2
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 50, 1, 1)])], ["t"])
    assert [b.num_rows for b in chunks([batch, batch.slice(0, 0)], "t", 10)] == [1, 1, 2]


def test_exact_dedup(spark):
    texts = ["a b", "a\t b", "c", None, "", "a b", "c"]
    ids = [3, 1, 5, 7, 6, None, None]
    for content_hash in (F.md5, lambda c: F.lit("same")):
        got = exact_dedup.exact_dedup(frame(spark, texts, ids), content_hash=content_hash).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in got) == [
            (False, 1, 1, 3, True), (False, 3, 1, 3, False), (False, 5, 5, 2, True), (False, 6, 6, 2, True), (False, 7, 6, 2, False), (True, 0, 1, 3, False), (True, 0, 5, 2, False),
        ]
        assert {r.text_sha256 for r in got if r.doc_id == 1} == {hashlib.sha256(b"a b").hexdigest()}
    alone = exact_dedup.exact_dedup(frame(spark, ["q", "q"], [None, None])).collect()
    assert [(r.keep_id, r.kept) for r in alone] == [(None, True)] * 2
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def thue_morse(n=2048):
    """Two words that hashes by polynomials modulo a power of two cannot tell apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    texts = pa.array(["x yy x " + " ".join(thue_morse()), "yy zz zz x", "zz"])
    for blind in (False, True):
        if blind:
            monkeypatch.setattr(Words, "hashes", lambda self: np.zeros(len(self.starts), np.uint64))
        w = Words(*buffers(texts), BLANK)
        first, kind = w.distinct()
        spelt = [w.data[a:z].tobytes() for a, z in zip(w.starts, w.ends, strict=True)]
        assert [spelt[k] for k in first[kind]] == spelt and len(first) == len(set(spelt)) == 5
        book = Lexicon([b"zz", thue_morse()[1].encode(), b"yy", b"none"])
        assert book.find(w).tolist() == [{b"zz": 0, thue_morse()[1].encode(): 1, b"yy": 2}.get(x, -1) for x in spelt]
        assert w.packed(first).to_pylist() == [spelt[k] for k in first]


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "B", "cc", "d1", "é", "the"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(n))
    docs = [(k, text(rng.randint(0, 200))) for k in range(60)] + list(enumerate(ODD, 100)) + [(200, "x" * 300_000 + " the the")]
    items = [(k, text(n)) for k, n in enumerate([0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 12])] + [(20, None), (None, "a B cc"), (21, docs[3][1][:60]), (21, "the the"), (22, "x" * 300_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontaminate.brute_force(docs, items))
    for size, limit in ((10, 10**6), (10, 30)):
        got = decontaminate.decontaminate(frame(spark, [t for _, t in docs], [d for d, _ in docs]), bench, size, broadcast_bytes=limit).collect()
        assert sorted(tuple(r)[:7] for r in got) == want
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    clean = decontaminate.decontaminate(frame(spark, ["a b"]), bench.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in clean] == [(2, 0, False)]


def test_decontamination_in_parts_keeps_rows(spark):
    words = [f"w{k}" for k in range(60)]
    a, b, clean = " ".join(words[:20]), " ".join(words[30:50]), " ".join(f"c{k}" for k in range(20))
    docs = [(None, a), (None, clean), (None, b), (7, clean), (7, a), (7, f"{a} {b}"), (7, a), (8, None), (9, " ".join([*words[:5], "or", *words[5:20]]))]
    items = [("x", a), ("y", b), ("z", " ".join(words[5:40]))]
    table = spark.createDataFrame(items, "item_id string, text string")
    key = lambda r: tuple(map(str, r))
    want = sorted(decontaminate.brute_force(docs, items), key=key)
    for most in (1, 90, 1_000_000):
        got = decontaminate.decontaminate(frame(spark, [t for _, t in docs], [d for d, _ in docs]), table, broadcast_bytes=most)
        assert sorted((tuple(r)[:7] for r in got.collect()), key=key) == want, most


def test_the_index_holds_all_tokens(spark):
    texts = ["b a, a", None, "C a"]
    rows = decontaminate.build_segments(frame(spark, texts).coalesce(1)).collect()
    assert len(rows) == 1
    index = decontaminate.Index.stored(rows[0].terms, rows[0].term_ends, rows[0].list_ends, rows[0].postings)
    found, ends, at = {}, [0, *index.term_ends.tolist()], [0, *index.list_ends.tolist()]
    for k in range(len(index.term_ends)):
        found[index.terms[ends[k] : ends[k + 1]].tobytes()] = index.postings[at[k] : at[k + 1]].tolist()
    assert found == {b"b": [0], b"a": [1, 2, 4], b"c": [3]}


def test_proximity():
    book = decontaminate.Phrases({(b"a", b"b"): {"1"}})
    w = Words(*buffers(pa.array(["a x b a b", "a x x x b"])), ALNUM)
    keys = decontaminate.Index.of(w).keys(book.lexicon)
    _, start, last = decontaminate.proximity_matches(book, keys, 1)
    assert sorted(zip(start.tolist(), last.tolist(), strict=True)) == [(0, 2), (3, 4)]
    assert decontaminate.phrase_matches(book, keys)[1].tolist() == [3]


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(9)
    lines = ["a b c d e", "f g", "h i j k l m n o p q r", "", "x  y", "one two three", " f g "]
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for k in range(40)] + [(50, None), (51, ""), (52, "tail\r\n" * 30)]
    want = line_dedup.brute_force(docs)
    got = line_dedup.line_dedup(frame(spark, [t for _, t in docs], [d for d, _ in docs]))
    assert got.columns == [*frame(spark, []).columns, "n_lines", "n_deleted"]
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_line_dedup_null_ids_and_repeats(spark):
    run = "one two three four five six\nseven eight nine ten eleven"
    got = line_dedup.line_dedup(frame(spark, [run, run, run + "\nnew", run], [4, None, 2, 4])).collect()
    # The row without an id comes first and stays; the others lose the run.
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in got) == [(False, 0, run), (True, 2, "new"), (True, 4, ""), (True, 4, "")]


def python_fingerprint(text, size=4):
    words = (text or "").translate(LOWER)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + size]).encode(), 42) for k in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_golay_keys_cover_all_links():
    g, rng = simhash.golay(), np.random.default_rng(1)
    low = np.arange(4096) << 11
    code = low | g.high[low >> 11 & 0xFFF]
    v = rng.integers(0, 1 << 23, 50)
    for x, own in zip(v, g.keys(v), strict=True):
        assert {k for k in own.tolist() if k >= 0} == set(np.flatnonzero(np.bitwise_count(code ^ x) <= 4).tolist())
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b)).astype(np.uint64)
    sets = []
    for x in (a, b):
        keys, rows = simhash.candidate_keys(x)
        own = collections.defaultdict(set)
        for k, r in zip(keys.tolist(), rows.tolist(), strict=True):
            own[r].add(k)
        sets.append(own)
    assert all(sets[0][k] & sets[1][k] for k in range(len(a)))


def components_by_hand(fps, bits=4):
    root = {d: d for d in fps}
    for d in sorted(fps):
        todo, seen = [d], {d}
        while todo:
            x = todo.pop()
            for y in fps:
                if y not in seen and (fps[x] ^ fps[y]).bit_count() <= bits:
                    seen.add(y)
                    todo.append(y)
        root[d] = min(seen)
    return root


def test_simhash_components(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(400)) for _ in range(6)]
    texts = list(ODD)
    for t in base:
        for _ in range(8):
            words = t.split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    want_fp = {k: python_fingerprint(t) for k, t in enumerate(texts)}
    want = components_by_hand(want_fp)
    got = simhash.simhash_components(frame(spark, texts)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{want_fp[k]:016x}", want[k]) for k in want}
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_link_bucket_equals_pairs():
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for c in rng.integers(0, 1 << 63, 3, dtype=np.uint64)]))
    forest = simhash.Forest()
    simhash.link_bucket(fps, forest, 4)
    want = components_by_hand({int(f): int(f) for f in fps})
    assert {f: forest.find(f) for f in want} == want


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 99), (99, 99)], "node long, root long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99}


def test_near_duplicates(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts, group = [], []
    for g in range(15):
        words = [word() for _ in range(250)]
        for _ in range(4):
            own = list(words)
            for at in rng.sample(range(0, 250, 10), 2):  # two words: ten of some 250 shingles
                own[at] = word()
            texts.append(" ".join(own))
            group.append(g)
    texts += [" ".join(word() for _ in range(200)) for _ in range(20)]
    group += range(100, 120)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    want = {}
    for k in range(len(texts)):
        near = [j for j in range(len(texts)) if group[j] == group[k] and len(sets[j] & sets[k]) >= 0.8 * len(sets[j] | sets[k])]
        assert len(near) == 4 or group[k] >= 100
        want[k] = min(near)
    assert got == want
    blank = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, ["", None, "a"])).collect()}
    assert blank == {0: 0, 1: 0, 2: 2}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_neighbours_of_buckets():
    rng = np.random.default_rng(4)
    fps = np.packbits(rng.random((300, 128)) < 0.12, axis=1).view(np.uint64)
    bits = int(np.median([np.bitwise_count(fps[a] ^ fps[a + 1]).sum() for a in range(0, 300, 2)]))
    for keys in (np.zeros(300, np.int32), np.repeat(np.arange(30, dtype=np.int32), 10)):
        nodes = rng.permutation(300).astype(np.int64)
        node, partner, _, more = simhash.neighbours(keys, nodes, fps, bits)
        at = {int(n): k for k, n in enumerate(nodes)}
        found = {n: (p, m) for n, p, m in zip(node.tolist(), partner.tolist(), more.tolist(), strict=True)}
        for x in range(300):
            close = {y for y in range(300) if y != x and keys[x] == keys[y] and np.bitwise_count(fps[x] ^ fps[y]).sum() <= bits}
            if len(keys[keys == keys[x]]) > simhash.PAIRWISE:
                assert found[int(nodes[x])][1]
            else:
                assert (int(nodes[x]) in found) == bool(close)
                assert not close or (at[found[int(nodes[x])][0]] in close and found[int(nodes[x])][1] == (len(close) > 1))


def test_prefix_pairs_lose_nothing(spark):
    rng = random.Random(3)
    sets = [set(rng.sample(range(40), rng.randint(1, 40))) for _ in range(80)]
    for k in range(0, 80, 2):  # near ones, by a few changes
        sets[k + 1] = set(sets[k]) ^ set(rng.sample(range(45), rng.randint(0, 4))) or {1}
    roots = [rng.randint(0, 30) for _ in sets]
    cells = lambda s: np.bincount(sorted(s), minlength=simhash.CELLS).tolist()
    rows = spark.createDataFrame([(k, r, sorted(s), cells(s)) for k, (s, r) in enumerate(zip(sets, roots, strict=True))], "node long, root long, shingles array<long>, cells array<int>")
    for t in (0.5, 0.8, 1.0):
        got = {tuple(r) for r in simhash.prefix_pairs(rows, t).collect()}
        want = {(a, b) for a in range(80) for b in range(a) if roots[a] != roots[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}
        assert want <= got and all(roots[a] != roots[b] for a, b in got)


def test_near_duplicates_of_one_template(spark):
    """One family of many sizes of change: components are those of all pairs, though most pairs are never listed."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(500):
        own = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 1, 2, 3, 4, 6, 8])):
            own[at] = word()
        texts.append(" ".join(own))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == {k: find(k) for k in range(len(texts))}


def test_near_duplicates_compare_sets(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    words = lambda n: [word() for _ in range(n)]
    groups = lambda texts: {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    phrase = words(5)
    # The phrase rules all bits of a fingerprint with repeats, but the texts have little in common.
    assert groups([" ".join(phrase * 60 + words(20)) for _ in range(3)]) == {0: 0, 1: 1, 2: 2}
    body, line = words(300), words(8)
    assert groups([" ".join(body + line), " ".join(body + line * 100)]) == {0: 0, 1: 0}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


NASTY = ["it's a don't. <|endoftext|> <|ENDOFTEXT|> x", "(abc).'s 's.'t  nb sp Ünï 12ab3.4", "İstanbul ﬁ ①½ x̱.", "a.<|endoftext|>b 'll.'re", "#", *ODD]


def test_token_ids(spark, library):
    ids = [None, *range(len(NASTY) - 1)]
    path = f"{spark.conf.get('spark.checkpoint.dir')}/ids"
    docs = frame(spark, NASTY, ids)
    got = token_ids.token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), path).collect()
    want, start = [], 0
    for d, t in sorted(zip(ids, NASTY, strict=True), key=lambda x: -1 if x[0] is None else x[0]):
        own = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == [(s, d, n, c) for d, s, n, c in want]
    assert token_ids.token_ids(empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_words_encoded_together(library):
    """Words that are given to the library in one text get the ids they have alone, those that hold the mark too."""
    rng = np.random.default_rng(7)
    signs = ["a", "b", "'s", "'", "!", "0", "é", "e", "\u0301", "\u00a0", "\u3000", "\x85", "Σ", "ā", "</w>", "<|endoftext|>", "<", "|", "ᄒ", "ᅡ", "\x00", "\x02", token_ids.MARK]
    own = token_ids.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert own.mark is not None
    for most in (len(signs) - 1, len(signs)):  # groups without the mark, and with it
        words = ["".join(rng.choice(signs[:most], rng.integers(1, 7))) for _ in range(3000)]
        want = [library.encode(w, add_special_tokens=False).ids for w in words]
        flat, sizes = own.flat([w.encode() for w in words])
        assert sizes.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_grammar_round_trip_and_access():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 5, n) for n in (0, 1, 400, 3, 900)] + [np.full(300, 7), np.tile([1, 2, 3, 4], 200)]
    ids, ends = np.concatenate(docs).astype(np.int32), np.cumsum([len(d) for d in docs])
    block = token_ids.Block(token_ids.pack(np.arange(len(docs)), np.ones(len(docs), np.uint8), ids, ends))
    assert len(block.table) > 0 and len(block.seq) < len(ids) / 2
    whole, where = block.all()
    assert whole.tolist() == ids.tolist() and where.tolist() == ends.tolist()
    for k, d in enumerate(docs):
        assert block.document(k).tolist() == d.tolist()
        for a, z in ((0, len(d)), (len(d) // 3, len(d) // 2)):
            assert z == a or block.slice(k, a, z).tolist() == d[a:z].tolist()
    with pytest.raises(ValueError):
        token_ids.Block(b"something else that is long enough to have a header")


def test_grammar_stops_where_no_rule_pays():
    rng = np.random.default_rng(1)
    for _ in range(300):
        docs = [rng.integers(0, rng.integers(1, 5), rng.integers(0, 60)) for _ in range(rng.integers(1, 6))]
        ids, ends = np.concatenate(docs).astype(np.int32), np.cumsum([len(d) for d in docs])
        seq, doc_end, table, lengths, base = token_ids.compress(ids, ends)
        assert token_ids.expand(seq, table, base).tolist() == ids.tolist()
        for k in range(len(table)):
            assert lengths[k] == len(token_ids.expand(np.array([base + k]), table, base))
        pairs = collections.Counter()
        for a, z, d in zip([0, *doc_end[:-1]], doc_end, docs, strict=True):
            own, before = seq[a:z].tolist(), None
            assert token_ids.expand(seq[a:z], table, base).tolist() == d.tolist()
            for p in zip(own, own[1:], strict=False):
                before = None if p == before else p  # of a run of one symbol every other pair
                pairs[p] += before is not None
        assert max(pairs.values(), default=0) < token_ids.LEAST


def test_words_of_one_hash_get_their_own_ids(spark, library):
    import sentencepiece as pieces

    one, other = thue_morse()
    texts = [one, other, f"{other} {one}"]
    got = {r.doc_id: r for r in token_ids.token_ids(frame(spark, texts).coalesce(1), public_tokenizers.path("word_bpe_49k.json")).collect()}
    for k, t in enumerate(texts):
        own = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (got[k].n_tokens, got[k].ids_crc32) == (len(own), zlib.crc32(own.tobytes()))
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = {r.doc_id: r.ids for r in sentencepiece.encode(frame(spark, texts).coalesce(1), model).collect()}
    assert rows == {k: pieces.SentencePieceProcessor(model_file=model).encode(t) for k, t in enumerate(texts)}


def test_long_stretches_take_linear_time():
    import sentencepiece as library

    model = public_tokenizers.path("piece_bpe_32k.model")
    own, rng = library.SentencePieceProcessor(model_file=model), random.Random(3)
    texts = [" " * n + tail for n in (64, 65, 79, 80, 81, 113, 5000) for tail in ("", "x", "the")] + ["".join(rng.choices("abcdeé/_日", k=20_000)), "ab" * 9_000]
    encoder = sentencepiece.Encoder(sentencepiece.Pieces(model))
    ids, sizes, _, _ = encoder.encode(pa.array(texts))
    at = 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == own.encode(t), (t[:5], len(t))
        at += n
    began = time.time()
    ids, sizes, data, _ = encoder.encode(pa.array([" " * 1_000_000, "xyz" * 100_000]))
    assert time.time() - began < 60 and encoder.decode(ids, sizes)[0].tobytes() == data.tobytes()


def test_line_dedup_of_many_blank_lines(spark):
    line = "one two three four five six seven eight nine ten"
    text = "\n" * 50_000 + line
    began = time.time()
    got = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup.line_dedup(frame(spark, [text, text, "x"])).collect()}
    assert got == {0: (text, 0), 1: ("", 50_001), 2: ("x", 0)} and time.time() - began < 300


def test_added_columns_clash_with_none(spark):
    schema = "doc_id long, text string, n_lines long, N_Deleted long, score double, contaminated boolean, gone_id long, text_md5 binary, n_chars long"
    docs = spark.createDataFrame([(k, t, 7, 8, 0.5, None, 1, b"x", 3) for k, t in enumerate(["a b", None])], schema)
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines_", "n_deleted_"] and [(r.n_lines, r.n_lines_) for r in out.orderBy("doc_id").collect()] == [(7, 1), (7, 1)]
    out = decontaminate.flagged(docs, bench)
    assert out.columns == [*docs.columns, "contaminated_"] and [r.contaminated_ for r in out.orderBy("doc_id").collect()] == [True, False]
    out = toxicity.scored(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert out.columns == [*docs.columns, "score_"] and [r.score_ for r in out.collect()] == [0, 0]
    import corpus_pipeline as pipeline

    docs.withColumn("toxic", F.lit(1)).select("doc_id", "toxic").write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/clash/labels.parquet")
    bench.write.parquet(path.replace("labels", "benchmark"))
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, path.removesuffix("/labels.parquet")).columns == docs.columns, name


def test_ids_must_be_whole_numbers(spark):
    docs = spark.createDataFrame([("12", "a b c"), (None, "a"), ("x1", "b")], "doc_id string, text string")
    assert sorted(str(r.doc_id) for r in simhash.simhash_components(docs.where("doc_id is null or doc_id = '12'")).collect()) == ["12", "None"]
    with pytest.raises(Exception, match="not a whole number"):
        simhash.simhash_components(docs).collect()


def test_sentencepiece_is_the_library(spark):
    import sentencepiece as library

    model = public_tokenizers.path("piece_bpe_32k.model")
    own = library.SentencePieceProcessor(model_file=model)
    rng = random.Random(1)
    texts = ["Hello  world\nfoo \t bar ", "http://www.example.com/aaa/bbb?x=1" * 5, " " * 70 + "x" + " " * 100 + "q", "İ½①ﬁ 😀 \x00", "the▁end", *ODD]
    texts += ["".join(rng.choice("abcdefgh AB 01.,-éß日  \n") for _ in range(rng.randint(1, 50))) for _ in range(1500)]
    texts += ["".join(rng.choice("ab e") for _ in range(rng.randint(1, 40))) for _ in range(700)]
    ids, sizes, data, offsets = sentencepiece.encoder(model).encode(pa.array(texts))
    at = 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == own.encode(t or ""), repr(t)
        at += n
    back, where = sentencepiece.encoder(model).decode(ids, sizes)
    assert back.tobytes() == data.tobytes() and where.tolist() == offsets.tolist()
    rows = sentencepiece.encode(frame(spark, texts[:20]), model).collect()
    assert {r.doc_id: r.decoded for r in rows} == {k: (t or "").replace("▁", " ") for k, t in enumerate(texts[:20])}
    assert all(r.round_trip for r in sentencepiece.digests(frame(spark, texts), model).collect())
    assert sentencepiece.digests(empty(spark), model).count() == 0


def test_unigram_viterbi_is_the_best_sum():
    pieces = sentencepiece.Pieces.__new__(sentencepiece.Pieces)
    pieces.bpe, pieces.one_line = False, False
    pieces.names = ["<unk>", "a", "b", "ab", "ba", "abb", "▁a", "▁", "bb"]
    pieces.scores = np.array([0, -2.0, -2.1, -3.0, -2.5, -3.3, -2.2, -1.9, -2.7])
    pieces.number = {p: k for k, p in enumerate(pieces.names) if k}
    pieces.unknown, pieces.bytes = 0, np.full(256, -1)
    pieces.decoded = [p.replace("▁", " ").encode() for p in pieces.names]
    own = sentencepiece.Encoder(pieces)
    rng = random.Random(2)

    def best(t):
        scores = [0.0] + [-math.inf] * len(t)
        for z in range(1, len(t) + 1):
            for a in range(z):
                if t[a:z] in pieces.number:
                    scores[z] = max(scores[z], scores[a] + pieces.scores[pieces.number[t[a:z]]])
        return scores[-1]

    for _ in range(300):
        t = rng.choice(["", "▁"]) + "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        ids = own._viterbi([t])[0]
        assert "".join(pieces.names[k] for k in ids) == t and math.isclose(sum(pieces.scores[k] for k in ids), best(t))


def test_token_counts_follow_edits(spark):
    own = token_counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(6)
    for _ in range(250):
        text = "".join(rng.choice("ab c  \n'st 12.,é日") for _ in range(rng.randint(0, 400)))
        doc = token_counts.Document(text, own)
        for _ in range(5):
            a = rng.randint(0, len(text))
            z = min(len(text), a + rng.choice([0, 1, 5, 60]))
            new = "".join(rng.choice("ab c  \n's1") for _ in range(rng.choice([0, 1, 4, 400])))
            text = text[:a] + new + text[z:]
            doc.edit(a, z, new)
            assert doc.text == text and doc.n_tokens == len(own.encoding.encode_ordinary(text)) and doc.n_words == len(own.pattern.findall(text))
    long = token_counts.Document("some words to count " * 5000, own)
    assert long.edit(50_000, 50_003, "other") < 12 and long.n_tokens == len(own.encoding.encode_ordinary(long.text))
    rows = token_counts.token_counts(frame(spark, ODD), token_counts.revision_edits(), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    for r in rows:
        text = ODD[r.doc_id] or ""
        assert r.n_tokens == len(own.encoding.encode_ordinary(text))
        n = len(text)
        for at, size, new in ((n // 4, 0, " (as amended)"), (n // 2, 12, ""), (n * 3 // 4, 5, "it's 2026 \n")):
            text = text[:at] + new + text[at + size :]
        assert r.n_tokens_edited == len(own.encoding.encode_ordinary(text)) and r.n_edits == 3
    table = spark.createDataFrame([(1, 2, 0, 1, "z"), (1, 1, 0, 0, "y"), (None, 1, 0, 0, "q")], "doc_id long, seq long, start int, end int, replacement string")
    assert [(r.doc_id, [e.replacement for e in r.edits]) for r in token_counts.edits_by_document(table).collect()] == [(1, ["y", "z"])]


def test_toxicity(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(rng.randint(1, 3)))
    texts, toxic = [], []
    for _ in range(900):
        words = [word() for _ in range(rng.randint(5, 200))]
        bad = rng.random() < 0.2
        for _ in range(rng.randint(1, 3) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["vile", "Awful", "rotten!"])
        texts.append(" ".join(words))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(k, 1, t) for k, t in enumerate(toxic)] + [(5000, 1, 1), (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [*texts, *ODD], [*range(900), *range(1000, 1000 + len(ODD))])
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, lambda c: id_crc(c) % 3 == 1).collect()}
    assert len(got) == 900 + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert {k for k in range(900) if got[k].held_out} == set(held)
    right = sum(got[k].predicted == toxic[k] for k in held) / len(held)
    assert right > 0.97
    assert all(r.score == 0 for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert toxicity.toxicity(empty(spark), labels).count() == 0


def plain_kneser_ney(classes, text):
    """The ratios of a text's words from two lists of texts, by dictionaries: the model as its definition has it."""
    split = lambda t: [None, *re.findall(r"[a-z0-9]+", t)]
    path = lambda w: [w[:n] for n in toxicity.PREFIXES] + [w]
    pairs = [collections.Counter(p for t in own for p in zip(split(t), split(t)[1:], strict=False)) for own in classes]

    def discounts(counts):
        n = collections.Counter(counts)
        out = [0, 0.5, 1.0, 1.5]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            for k in (1, 2, 3):
                if n[k] and n[k + 1]:
                    out[k] = min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1 * k), k)
        return lambda x: out[min(x, 3)]

    words = {w for own in pairs for _, w in own}
    seen, logs, left, total = [], [], [], []
    for k in range(len(toxicity.PREFIXES) + 1):
        met = [collections.defaultdict(set) for _ in classes]
        over = {path(w)[k]: path(w)[k - 1] if k else "" for w in words}
        for own, m in zip(pairs, met, strict=True):
            for u, w in own:
                m[path(w)[k]].add(u)
        n = [{x: len(m[x]) for x in over} for m in met]
        up = [collections.Counter() for _ in classes]
        off = [collections.Counter() for _ in classes]
        for c in (0, 1):
            d = discounts([x for x in n[c].values() if x])
            for x, p in over.items():
                up[c][p] += n[c][x]
                off[c][p] += d(n[c][x])
        rest = [{p: min(max(off[c][p] / up[c][p], 1e-3), 1) if up[c][p] else 1.0 for p in over.values()} for c in (0, 1)]
        both = {p: up[0][p] + up[1][p] for p in over.values()}
        own = []
        for c in (0, 1):
            d = discounts([x for x in n[c].values() if x])
            own.append({x: math.log((n[c][x] - d(n[c][x])) / max(up[c][p], 1) + rest[c][p] * (n[0][x] + n[1][x]) / both[p]) for x, p in over.items()})
        seen.append({x: n[0][x] + n[1][x] for x in over})
        logs.append(own)
        left.append(rest)
        total.append(both)

    def alone(w):
        out, parent = 0.0, ""
        for k, x in enumerate(path(w)):
            if seen[k].get(x, 0) < toxicity.STEP_LEAST:
                return out + (math.log(left[k][1][parent] / left[k][0][parent]) if total[k].get(parent, 0) >= toxicity.STEP_LEAST else 0.0)
            out += logs[k][1][x] - logs[k][0][x]
            parent = x
        return out

    sizes = [collections.Counter() for _ in classes]
    taken = [collections.Counter() for _ in classes]
    cuts = [discounts(own.values()) for own in pairs]
    for c, own in enumerate(pairs):
        for (u, _), n in own.items():
            sizes[c][u] += n
            taken[c][u] += cuts[c](n)
    rest = lambda c, u: min(max(taken[c][u] / sizes[c][u], 1e-3), 1) if sizes[c][u] else 1.0

    def log(c, u, w):
        n = pairs[c][u, w]
        return math.log((n - cuts[c](n)) / max(sizes[c][u], 1) + rest(c, u) * math.exp(sum(logs[k][c][x] for k, x in enumerate(path(w)))))

    out = []
    for u, w in zip(split(text), split(text)[1:], strict=False):
        if pairs[0][u, w] + pairs[1][u, w] >= toxicity.LEAST:
            out.append(log(1, u, w) - log(0, u, w))
        else:
            out.append(alone(w) + (math.log(rest(1, u) / rest(0, u)) if sizes[0][u] + sizes[1][u] >= toxicity.LEAST else 0.0))
    return out


def test_toxicity_likelihoods_are_kneser_ney(monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST", 3)
    rng = random.Random(2)
    word = lambda: rng.choice(["ab", "abcd", "abcde", "abcxyzuvwabcd", "abcxyzuvwabce", "q", "rst", "rstu", "mno", "mnopq"])
    classes = [[" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(20 + 10 * c)] for c in (0, 1)]
    classes[1] = [t + " vile rst" for t in classes[1]]
    model = toxicity.KneserNey([[(toxicity.paths(w), toxicity.before(w, w.hashes())) for w in [Words(*buffers(pa.array(own)), ALNUM)]] for own in classes])
    for text in ("vile rst vile abcd new words abcq rstu", classes[0][0], classes[1][3], "q"):
        got = model.each(Words(*buffers(pa.array([text])), ALNUM))
        want = plain_kneser_ney(classes, text)
        assert np.allclose(got, want, atol=1e-9), text
        x = model.features(Words(*buffers(pa.array([text, ""])), ALNUM))
        assert math.isclose(x[0, 0], sum(want) / len(want), abs_tol=1e-9) and not x[1].any()


def test_language(spark):
    got = queries.op5_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    odd = language.language_id(frame(spark, [*ODD, "123 ...", "Das ist"])).collect()
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {0, 1, 2, 3, 12, len(ODD)} and all(0 <= r.score <= 1 for r in odd)
    lone = frame(spark, ["das ist " * 2_000_000, "the cat"], [None, None]).withColumn("lang", F.when(F.col("text") == "the cat", "en").otherwise("de"))
    assert set(language.trees(lone, F.lit(True))) == {"de", "en"}  # a language of one text over the bound has a tree too
    assert {r.lang_pred for r in language.language_id(frame(spark, ["abc"]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.language_id(empty(spark)).count() == 0


def test_language_costs_are_code_lengths():
    data = np.frombuffer(b"abracadabra abracadabra", np.uint8)
    keys, counts = np.unique(language.grams(data, np.array([0, len(data)])), return_counts=True)
    tree = language.Tree(np.stack((keys, counts)))
    seen = collections.Counter(keys.repeat(counts).tolist())

    def cost(key):
        bits = 0.0
        for k in range(language.ORDER, -1, -1):
            sub = lambda x, k=k: x & ((1 << 8 * (k + 1)) - 1)
            below = collections.Counter()
            for x, n in seen.items():
                if sub(x) >> 8 == sub(key) >> 8:
                    below[x & 255] += n
            n, d = sum(below.values()), len(below)
            if not n:
                continue
            if below[key & 255]:
                return bits - math.log2(below[key & 255] / (n + d))
            bits -= math.log2(d / (n + d))
        return bits + 8

    asked = np.unique(language.grams(np.frombuffer(b"cadabra zzz ab", np.uint8), np.array([0, 14])))
    assert np.allclose(tree.costs(asked), [cost(k) for k in asked.tolist()], atol=1e-4)


def lm_tokens(text):
    return [*(w.encode() for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w), lm_score.END]


def test_lm_score(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    tokens = {d: lm_tokens(t) for d, t in docs}
    counts = collections.Counter(w for d, own in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in own)
    n, v = sum(counts.values()), len(counts)
    first = None
    for known in (10**6, 500):
        monkeypatch.setattr(lm_score, "KNOWN", known)
        got = {r.doc_id: r for r in queries.op3_lm_score(spark, SF).collect()}
        for d, own in tokens.items():
            r = got[d]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
            assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        held = [r for r in got.values() if r.held_out]
        assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)
        assert first is None or all(math.isclose(first[d].score, got[d].score, rel_tol=1e-9) for d in got)
        first = got


def plain_lm(texts, training, rounds):
    """Scores and likelihoods by plain loops over dictionaries: the model as its definition has it."""
    tokens = [lm_tokens(t) for t in texts]
    counts = collections.Counter(w for own in (tokens[k] for k in training) for w in own)
    singles = sorted(counts, key=lambda w: (-counts[w], w))[: lm_score.SINGLE]
    hashed = lambda x, n: int((lm_score.mix(np.array([x], np.uint64)) % np.uint64(n))[0])

    def tail(w):
        if w == lm_score.END:
            return 0
        mark = w[-1] < 48 and len(w) > 1
        w = w[:-1] if mark else w
        return hashed(w[-1] | (w[-2] if len(w) > 1 else 0) << 8 | mark << 16, lm_score.TAIL)

    class_of = lambda w: singles.index(w) if w in singles else lm_score.SINGLE + tail(w)
    word_hash = lambda w: 0 if w in (None, lm_score.END) else int(hash_ranges(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] % np.uint64(lm_score.HASHED))
    start, cells = lm_score.CLASSES, []
    for own in tokens:
        c = [class_of(w) for w in own]
        back = lambda k, n, c=c: c[k - n] if k >= n else start
        cells.append([(c[k], [(0, back(k, 1)), (1, hashed(back(k, 2) * (start + 1) + back(k, 1), lm_score.HASHED)), (2, back(k, 2)), (3, back(k, 3)), (4, word_hash(own[k - 1] if k else None))]) for k in range(len(own))])
    seen = collections.Counter(c for k in training for c, _ in cells[k])
    prior = [(seen[c] + 1) / (sum(seen.values()) + start) for c in range(start)]
    observed = collections.Counter((f, c) for k in training for c, fs in cells[k] for f in fs)
    total = collections.Counter(f for k in training for _, fs in cells[k] for f in fs)
    weights = {}
    step = lambda o, e, c: math.log((o + lm_score.PRIOR * prior[c]) / (e + lm_score.PRIOR * prior[c])) / 5
    for f in total:
        for c in range(start):
            weights[f, c] = step(observed[f, c], total[f] * prior[c], c)

    def distribution(fs):
        raw = [math.log(prior[c]) + sum(weights.get((f, c), 0.0) for f in fs) for c in range(start)]
        z = math.log(sum(map(math.exp, raw)))
        return [x - z for x in raw]

    history = []
    for _ in range(rounds):
        expected, likelihood = collections.Counter(), 0.0
        for k in training:
            for c, fs in cells[k]:
                logs = distribution(fs)
                likelihood += logs[c]
                for f in fs:
                    for x in range(start):
                        expected[f, x] += math.exp(logs[x])
        history.append(likelihood)
        for f, c in weights:
            weights[f, c] += step(observed[f, c], expected[f, c], c)
    mass = collections.Counter()
    for w, n in counts.items():
        if w not in singles:
            mass[tail(w)] += n + 1
    scores = []
    for own, cell in zip(tokens, cells, strict=True):
        s = sum(distribution(fs)[c] / math.log(10) for c, fs in cell)
        scores.append(s + sum(math.log10((counts[w] + 1) / (mass[tail(w)] + 1)) for w in own if w not in singles))
    return scores, history


def test_lm_score_is_the_model(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "."]) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, range(60, 0, -1), k=rng.randint(0, 15))) for _ in range(24)] + [None, "zzz never SEEN"]
    training = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 7 != 2]
    want, history = plain_lm(texts, training, lm_score.ROUNDS)
    got = {r.doc_id: r.score for r in lm_score.lm_score(frame(spark, texts), id_crc() % 7 == 2, known_words=20).collect()}
    assert all(math.isclose(got[k], want[k], rel_tol=1e-4) for k in got) and len(got) == len(texts)
    rows = frame(spark, [texts[k] for k in training]).select(F.col("text").alias("t"))
    words = sorted(lm_score.vocabulary(rows).collect(), key=lambda r: (-r.c, r.w))
    _, rises = lm_score.train(rows, lm_score.Singles([bytes(r.w) for r in words[: lm_score.SINGLE]]), 4)
    assert np.allclose(rises[: lm_score.ROUNDS], history, rtol=1e-4) and all(a < b for a, b in zip(rises, rises[1:], strict=False))


def test_lm_tells_words_apart_by_bytes(spark):
    one, other = thue_morse()
    got = lm_score.lm_score(frame(spark, [f"{one} {other} {one}", other, one]), F.lit(False)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(4, 4, 8), (2, 2, 8)}
    text = next(r for r in got if r.n_tokens == 4)
    assert math.isclose(text.base_score, sum(math.log10((c + 1) / (8 + 3 + 1)) for c in (3, 2, 3, 3)))


def test_lm_score_odd_rows(spark):
    docs = frame(spark, [*ODD, "a tail of words", "a tail of words", None], [*range(len(ODD)), 77, 77, None])
    got = lm_score.lm_score(docs, id_crc() % 7 == 2, known_words=3).collect()
    assert len(got) == len(ODD) + 3 and all(r.n_tokens >= 1 and r.score < 0 and r.base_score < 0 for r in got)
    twins = [(r.n_known, r.score) for r in got if r.doc_id == 77]
    assert twins[0] == twins[1]
    assert {r.score for r in lm_score.lm_score(docs, F.lit(True)).collect() if r.n_tokens == 1} != set()
    assert lm_score.lm_score(empty(spark), id_crc() % 7 == 2).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        before, kept = kept, spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        assert kept.columns == docs.columns, name
        assert {r.doc_id for r in kept.collect()} <= {r.doc_id for r in before.collect()}
        if name == "line_dedup":
            assert {r.doc_id: r.text for r in kept.collect()} == line_dedup.brute_force([(r.doc_id, r.text) for r in before.collect()])
            assert all(r.n_chars == len(r.text) for r in kept.collect())
        if name == "benchmark_decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            dirty = {r[0] for r in decontaminate.brute_force([(r.doc_id, r.text) for r in before.collect()], items) if r[-1]}
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in kept.collect()} == dirty
    last = pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert len(last) == kept.count() and all(r.round_trip for r in last)
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in pipeline.run(spark, SF).collect()} == {r.doc_id: (r.n_tokens, r.ids_crc32) for r in last}


def test_pipeline_decides_per_row(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    a, b, clean, other = ([word() for _ in range(120)] for _ in range(4))
    join = lambda words: " ".join(words)
    spark.createDataFrame([("x", join(a[:20]))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, join(a)), (None, join(clean)), (4, join(a)), (4, join(b))]
    for kept in (
        pipeline.drop_contaminated(spark, frame(spark, [t for _, t in rows], [d for d, _ in rows]), str(tmp_path)),
        decontaminate.flagged(frame(spark, [t for _, t in rows], [d for d, _ in rows]), spark.createDataFrame([("x", join(a[:20])), ("y", "zz")], "item_id string, text string"), broadcast_bytes=1).where("not contaminated").drop("contaminated"),
    ):
        assert {(r.doc_id, r.text) for r in kept.collect()} == {(None, join(clean)), (4, join(b))}
    near = [*b[:60], word(), *b[61:]]
    rows = [(None, join(b)), (2, join(b)), (3, join(near)), (3, join(clean)), (9, join(other)), (None, join(other[:119]))]
    kept = pipeline.drop_near_copies(spark, frame(spark, [t for _, t in rows], [d for d, _ in rows]), str(tmp_path))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted((str(d), t) for d, t in rows if t != join(near))
