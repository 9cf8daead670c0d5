"""Golden vectors of the writers' rules, and the reads over them."""

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import values as V
from chronoloom.operators import arrival, dictionary, oplog, reads, runs, scans, temporal_joins, versions

M = oplog.FOREVER
SCHEMA = "seq long, id long, attr string, op string, s string, ts long"


def log(spark, ops):
    """ops: (attr, op, text, ts) of one entity, or with the entity first."""
    rows = [(k, *(o if len(o) == 5 else (1, *o))) for k, o in enumerate(ops)]
    df = spark.createDataFrame(rows, SCHEMA)
    value = F.when(F.col("op") == "PUT", V.string(F.col("s"))).when(F.col("op") == "TOMB", V.tombstone())
    return df.select("seq", "id", "attr", "op", value.alias("value"), "ts")


def puts(text, attr="x"):
    """'A@100 -@200' as operations; - is a tombstone."""
    return [(attr, "TOMB" if v == "-" else "PUT", None if v == "-" else v, int(t)) for v, t in (x.split("@") for x in text.split())]


VECTORS = {
    "V1": ("A@100 A@150 B@200 B@250 B@300 C@400", [(100, 150, 199, "A"), (200, 300, 399, "B"), (400, 400, M, "C")]),
    "V2": ("A@100 A@300 B@150", [(100, 300, 149, "A"), (150, 150, 150, "B"), (151, 300, M, "A")]),
    "V2b": ("A@100 B@150 A@300", [(100, 100, 149, "A"), (150, 150, 299, "B"), (300, 300, M, "A")]),
    "V3": ("A@1000 B@500", [(500, 500, 999, "B"), (1000, 1000, M, "A")]),
    "V4": ("A@100 B@300 B@200", [(100, 100, 299, "A"), (200, 300, M, "B")]),
    "V5": ("A@100 A@200 H@150 A@150", [(100, 200, 149, "A"), (150, 150, 150, "A"), (151, 200, M, "A")]),
    "V9": ("30@10 -@20 -@21 40@30", [(10, 10, 19, "30"), (20, 21, 29, "-"), (30, 30, M, "40")]),
    "V10": ("7@0 99@500", [(0, 0, 499, "7"), (500, 500, M, "99")]),
    "V11": ("7@0 7@100 8@50", [(0, 100, 49, "7"), (50, 50, 50, "8"), (51, 100, M, "7")]),
    "V12": ("A@10 A@20 B@20", [(10, 20, 19, "A"), (20, 20, M, "B")]),
    "V13": ("-@100", [(100, 100, M, "-")]),
    "V14": ("A@100 A@400 C@300 B@200", [(100, 400, 199, "A"), (200, 200, 200, "B"), (201, 400, 299, "A"), (300, 300, 300, "C"), (301, 400, M, "A")]),
    "V15": ("30@100 -@200 29@50", [(50, 50, 99, "29"), (100, 100, 199, "30"), (200, 200, M, "-")]),
    "V16": ("1@1000 2@2000 1@3000 2@4000 1@2000", [(1000, 1000, 1999, "1"), (2000, 2000, 2999, "1"), (3000, 3000, 3999, "1"), (4000, 4000, M, "2")]),
}


@pytest.mark.parametrize("name", VECTORS)
def test_fold_vector(name):
    text, want = VECTORS[name]
    ops = [(int(t), v, v) for v, t in (x.split("@") for x in text.split())]
    assert [tuple(r[:4]) for r in arrival.fold(ops)] == want


def test_arrival_runs_publish_valid_to(spark):
    ops = log(spark, [(k, *o) for k, (text, _) in enumerate(VECTORS.values()) for o in puts(text)])
    got = arrival.arrival_runs(ops, ["id"]).orderBy("id", "first_seen").collect()
    for k, (_, want) in enumerate(VECTORS.values()):
        own = [(r.first_seen, r.last_seen, r.raw_valid_to, r.value.s or "-", r.valid_to) for r in got if r.id == k]
        assert [x[:4] for x in own] == want
        assert [x[4] for x in own] == [*(w[0] - 1 for w in want[1:]), M]
    assert {r.is_tombstone for r in got if r.value.s is None} == {True}


def test_canonical_equals_fold_in_order(spark):
    rng = random.Random(3)
    ops, want = [], {}
    for e in range(60):
        ts, own = 0, []
        for _ in range(rng.randint(1, 12)):
            ts += rng.randint(1, 5)
            v = rng.choice("AAB-")
            own.append((ts, v, v))
            ops.append((e, "x", "TOMB" if v == "-" else "PUT", None if v == "-" else v, ts))
        want[e] = [tuple(r[:4]) for r in arrival.fold(own)]
    for bucket in (None, 7):
        got = {}
        for r in runs.canonical_runs(log(spark, ops), ["id"], bucket).orderBy("id", "first_seen").collect():
            got.setdefault(r.id, []).append((r.first_seen, r.last_seen, r.valid_to, r.value.s or "-"))
        assert got == want


def test_same_time_keeps_last_arrival(spark):
    r = runs.canonical_runs(log(spark, puts("A@10 B@10 A@20")), ["id"]).orderBy("first_seen").collect()
    assert [(x.first_seen, x.value.s) for x in r] == [(10, "B"), (20, "A")]


def latest(spark, ops):
    ops = oplog.since_drop(log(spark, ops), ["id"])
    own = runs.canonical_runs(ops, ["id"])
    return {r.attr: r.value.s for r in reads.get_latest(own, ["id"], ops).collect()}


def test_latest_with_siblings_clears_and_drops(spark):
    assert latest(spark, [*puts("A@100"), *puts("Z@50", "y")]) == {"x": "A", "y": "Z"}  # V6
    assert latest(spark, [*puts("A@100"), *puts("Z@0", "y")]) == {"x": "A", "y": "Z"}  # V6b
    clear = ("b", "CLEAR", None, 0)
    assert latest(spark, [*puts("1@10", "a"), *puts("2@10", "b"), clear, *puts("3@20", "a")]) == {"a": "3"}  # V7
    assert latest(spark, [*puts("1@10", "a"), ("a", "CLEAR", None, 0), *puts("1@20", "a")]) == {"a": "1"}  # V8
    assert latest(spark, [*puts("1@10"), (None, "DROP", None, 0), *puts("2@5")]) == {"x": "2"}
    assert latest(spark, puts("30@10 -@20")) == {}


def test_point_reads(spark):
    own = runs.canonical_runs(log(spark, puts("30@10 -@20 -@21 40@30")), ["id"]).persist()
    at = lambda t: [r.value.s for r in reads.get_at(own, t, "x").collect()]
    assert (at(5), at(15), at(25), at(35)) == ([], ["30"], [], ["40"])
    assert [r.is_tombstone for r in reads.history(own, ["id"], "x").collect()] == [False, True, False]
    n = reads.neighbours(own, ["id"], 22).first()
    assert (n.predecessor, n.successor, n.leftmost, n.rightmost) == (20, 30, 10, 30)


def test_history_range(spark):
    own = runs.canonical_runs(log(spark, puts("10@100 20@200 30@300")), ["id"])
    values = lambda a, z: sorted(r.value.s for r in reads.history_range(own, a, z, "x").collect())
    assert values(150, 250) == ["10", "20"]
    assert values(0, 50) == []
    assert values(250, 150) == []


def test_states_and_versions(spark):
    own = runs.canonical_runs(log(spark, [*puts("alpha@0", "label"), *puts("10@100 20@200", "score")]), ["id"]).persist()
    state = lambda t: {k: v.s for r in reads.get_all_at(own, ["id"], t).collect() for k, v in r.state.items()}
    assert state(150) == {"label": "alpha", "score": "10"}
    assert state(250) == {"label": "alpha", "score": "20"}
    assert state(50) == {"label": "alpha"}
    got = [(r.first_seen, r.valid_to, {k: v.s for k, v in r.state.items()}) for r in versions.versions(own, ["id"]).orderBy("first_seen").collect()]
    assert got == [(0, 99, {"label": "alpha"}), (100, 199, {"label": "alpha", "score": "10"}), (200, M, {"label": "alpha", "score": "20"})]


def test_versions_skip_empty_states(spark):
    own = runs.canonical_runs(log(spark, puts("A@10 -@20 B@30")), ["id"])
    got = [(r.first_seen, r.valid_to) for r in versions.versions(own, ["id"]).orderBy("first_seen").collect()]
    assert got == [(10, 19), (30, M)]


def test_asof_batch(spark):
    own = runs.canonical_runs(log(spark, puts("A@10 -@20 B@30")), ["id"])
    probes = spark.createDataFrame([(1, "x", t, str(t)) for t in (5, 10, 19, 20, 31)] + [(2, "x", 10, "other")], "id long, attr string, ts long, note string")
    got = {r.note: r.value and r.value.s for r in reads.asof_batch(own, probes, ["id"]).collect()}
    assert got == {"5": None, "10": "A", "19": "A", "20": None, "31": "B", "other": None}


def test_state_changes(spark):
    got = runs.state_changes(log(spark, puts("A@10 A@20 B@20 B@30 A@25")), ["id"]).orderBy("seq").collect()
    # In order of time: A@10, (A@20 replaced by) B@20, A@25, B@30.
    assert [r.changed for r in got] == [True, False, True, True, True]


def test_values_compare_by_type_and_bits(spark):
    cases = [V.int32(F.lit(1)), V.int64(F.lit(1)), V.float64(F.lit(0.0)), V.float64(F.lit(-0.0)), V.string(F.lit("x")), V.json(F.lit("x")), V.binary(F.lit(b"x")), V.boolean(F.lit(True)), V.null_value(), V.tombstone()]
    keys = spark.range(1).select(*(V.comparison_key(c).alias(f"k{n}") for n, c in enumerate(cases))).first()
    assert len(set(keys)) == len(cases) and None not in keys


def test_accessors_widen_or_raise(spark):
    row = spark.range(1)
    got = row.select(V.as_long(V.int32(F.lit(7))), V.as_float64(V.float32(F.lit(1.5))), V.as_string(V.json(F.lit("[]"))), V.as_bool(V.boolean(F.lit(True))), V.as_bytes(V.binary(F.lit(b"z")))).first()
    assert list(got) == [7, 1.5, "[]", True, b"z"]
    with pytest.raises(Exception, match="not a string"):
        row.select(V.as_string(V.int32(F.lit(7)))).collect()


def test_validation(spark):
    ops = log(spark, [*puts("A@10"), ("x", "PUT", "late", -1), (None, "PUT", "v", 5), ("x", "MOVE", "v", 5), ("x", "PUT", "y" * 70_000, 5), ("x", "PUT", None, 5)])
    good, bad = oplog.validated(ops, ["id"])
    assert sorted(r.seq for r in good.collect()) == [0, 5]
    assert {r.seq: r.reason.split()[0] for r in bad.collect()} == {1: "time", 2: "no", 3: "unknown", 4: "payload"}
    assert [r.value.tag for r in good.where("seq = 5").collect()] == [V.NULL]


def test_copy_replay_keeps_point_reads(spark):
    ops = log(spark, [(k, *o) for k, (text, _) in enumerate(VECTORS.values()) for o in puts(text)])
    first = arrival.arrival_runs(ops, ["id"]).persist()
    again = arrival.copy_replay(first, ["id"]).persist()
    for t in (0, 15, 50, 120, 151, 250, 450, 1500, 3500):
        at = lambda r, t=t: sorted((x.id, x.value.s) for x in reads.get_at(r, t, "x").collect())
        assert at(first) == at(again), t


def test_put_all_and_size(spark):
    rows = spark.createDataFrame([(1, {"a": "1", "b": None}), (2, {}), (3, None)], "id long, m map<string,string>")
    attributes = F.transform_values("m", lambda _, v: V.string(v))
    ops = oplog.put_all(rows, ["id"], F.col("id"), attributes, 5)
    assert sorted((r.attr, r.value.tag) for r in ops.collect()) == [("a", V.STRING), ("b", V.NULL)]
    assert tuple(scans.size(ops, ["id"]).first()) == (1, False)
    assert tuple(scans.size(ops.limit(0), ["id"]).first()) == (0, True)


def test_cleared_or_tombstoned_entities_count(spark):
    ops = log(spark, [(1, *puts("A@1")[0]), (1, "x", "CLEAR", None, 0), (2, *puts("-@1")[0]), (3, "x", "CLEAR", None, 0), (4, *puts("A@1")[0]), (4, None, "DROP", None, 0)])
    assert scans.size(oplog.since_drop(ops, ["id"]), ["id"]).first().n_entities == 2


def test_versions_compare_states_not_their_text(spark):
    ops = [("a", "PUT", "x\x00b\x016:y", 10), ("a", "PUT", "x", 20), ("b", "PUT", "y", 20)]
    own = runs.canonical_runs(log(spark, ops), ["id"])
    got = [(r.first_seen, len(r.state)) for r in versions.versions(own, ["id"]).orderBy("first_seen").collect()]
    assert got == [(10, 1), (20, 2)]


def writer(ops):
    """The writers' rules once more, over a plain list: (first_seen, last_seen, valid_to, value) of one attribute."""
    own = []
    for ts, v in ops:
        own.sort()
        before = [r for r in own if r[0] <= ts]
        after = [r for r in own if r[0] >= ts]
        p = before[-1] if before else None
        if p and p[3] == v:
            p[1] = max(p[1], ts)
        elif p and ts <= p[1]:
            first, last, until, value = p
            own.remove(p)
            if first < ts:
                own.append([first, last, ts - 1, value])
            if ts < until and last > ts:
                own += [[ts, ts, ts, v], [ts + 1, last, until, value]]
            else:
                own.append([ts, ts, until, v])
        elif after and after[0][3] == v:
            after[0][0] = ts
        else:
            own.append([ts, ts, after[0][0] - 1 if after else M, v])
            if p:
                p[2] = ts - 1
    return [tuple(r) for r in sorted(own)]


def test_arrival_and_replay_of_random_logs(spark):
    rng = random.Random(8)
    logs = {e: [(rng.randint(0, 12), rng.choice("AAB-")) for _ in range(rng.randint(1, 14))] for e in range(120)}
    ops = [(e, "x", "TOMB" if v == "-" else "PUT", None if v == "-" else v, ts) for e, own in logs.items() for ts, v in own]
    rng.shuffle(ops)
    logs = {e: [(o[4], o[3] or "-") for o in ops if o[0] == e] for e in logs}
    made = arrival.arrival_runs(log(spark, ops), ["id"]).persist()
    got = {}
    for r in made.orderBy("id", "first_seen").collect():
        got.setdefault(r.id, []).append((r.first_seen, r.last_seen, r.raw_valid_to, r.value.s or "-"))
    assert got == {e: writer(own) for e, own in logs.items()}
    for n in (made, arrival.copy_replay(made, ["id"])):
        found = {(r.id, r.first_seen): (r.valid_to, r.value.s or "-") for r in n.collect()}
        for e, own in logs.items():
            want = writer(own)
            for t in range(14):
                now = [x for x in want if x[0] <= t]
                held = [(k, v) for k, v in found.items() if k[0] == e and k[1] <= t <= v[0]]
                assert [v[1] for _, v in held] == [x[3] for x in now[-1:]], (e, t)


def test_interval_join_of_random_runs(spark):
    rng = random.Random(5)
    ops = [(rng.randint(1, 6), rng.choice("xyz"), "PUT" if (v := rng.choice("ABC-")) != "-" else "TOMB", v if v != "-" else None, rng.randint(0, 25)) for _ in range(200)]
    own = runs.canonical_runs(log(spark, ops), ["id"]).persist()
    rows = [(r.id, r.attr, r.first_seen, r.valid_to, r.value.s) for r in own.where("not is_tombstone").collect()]
    want = sorted((a[0], max(a[2], b[2]), min(a[3], b[3]), a[4], b[4]) for a in rows for b in rows if a[0] == b[0] and a[1] == "x" and b[1] == "y" and max(a[2], b[2]) <= min(a[3], b[3]))
    assert want == sorted((r.id, r.overlap_from, r.overlap_to, r.left_value.s, r.right_value.s) for r in temporal_joins.interval_join(own, ["id"], "x", "y").collect())


def test_attribute_names_are_numbered(spark):
    ops = log(spark, [*puts("1@1", "b"), *puts("1@1", "a"), *puts("2@1", "b"), (1, None, "DROP", None, 0)])
    assert {r.value: r.code for r in dictionary.attributes(ops).collect()} == {"b": 1, "a": 2}
