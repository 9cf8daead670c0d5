"""Keys, dictionaries, ingest, the store and streaming."""

import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import keys as K
from chronoloom.functions import values as V
from chronoloom.operators import dictionary, oplog, runs, scans
from chronoloom.sources import cells
from chronoloom.sources import store as stores
from chronoloom.sources.store import Closed, Damaged, LayoutMismatch, Store
from chronoloom.streaming import ingest

LAYOUT = K.KeyLayout.of(kind="dict16", id="uint32")


def test_layout():
    assert (LAYOUT.width, LAYOUT.offset("id"), LAYOUT.names, LAYOUT.field(1).kind) == (6, 2, ["kind", "id"], "uint32")
    assert K.KeyLayout.from_fingerprint(LAYOUT.fingerprint()) == LAYOUT
    for bad in (lambda: K.KeyLayout(()), lambda: K.KeyField("a", "uint7"), lambda: K.KeyLayout((K.KeyField("a", "uint8"), K.KeyField("a", "uint8")))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        LAYOUT.field("none")


def test_codecs_order_and_invert(spark):
    signed = [-(2**63), -5, -1, 0, 1, 2**63 - 1]
    df = spark.createDataFrame([(x,) for x in signed], "x long").select("x", K.encode_int(F.col("x"), 8, True).alias("b"))
    rows = df.select("x", "b", K.decode_int(F.col("b"), 0, 8, True).alias("y")).collect()
    assert [r.x for r in sorted(rows, key=lambda r: bytes(r.b))] == signed and all(r.x == r.y for r in rows)
    big = [0, 1, 2**32, 2**63, 2**64 - 1]
    df = spark.createDataFrame([(Decimal(x),) for x in big], "x decimal(20,0)").select("x", K.encode_int(F.col("x"), 8).alias("b"))
    rows = df.select("x", "b", K.decode_int(F.col("b"), 0, 8).alias("y")).collect()
    assert all(bytes(r.b) == struct.pack(">Q", int(r.x)) and r.x == r.y for r in rows)
    assert bytes(spark.range(1).select(K.encode_int(F.lit(258), 2)).first()[0]) == b"\x01\x02"


def test_string_codec_and_limit(spark):
    for text in ("", "abc", "\x00\x01x", "é"):
        raw = K.encode_string(text)
        assert K.decode_string(raw) == text
        assert spark.createDataFrame([(text,)], "s string").select(K.encoded_length(F.col("s"))).first()[0] == len(raw)
    long = spark.createDataFrame([("x" * 128, 1)], "s string, n long")
    with pytest.raises(Exception, match="128 bytes"):
        dictionary.intern(long, "s", F.col("n")).collect()


def test_key_range(spark):
    bad = spark.createDataFrame([("a", -1)], "kind string, id long")
    with pytest.raises(Exception, match="out of range"):
        LAYOUT.cast(bad).collect()


def test_dictionary(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 0), ("c", 4)], "s string, n long")
    d = dictionary.intern(rows.where("n < 4"), "s", F.col("n"))
    assert {r.value: r.code for r in d.collect()} == {"b": 1, "a": 2}
    more = dictionary.intern(rows, "s", F.col("n"), d)
    assert {r.value: r.code for r in more.collect()} == {"b": 1, "a": 2, "c": 3}
    asked = spark.createDataFrame([("a",), ("z",), (None,)], "s string")
    assert {r.s: r.code for r in dictionary.resolve(asked, "s", more).collect()} == {"a": 2, "z": -1, None: 0}
    back = spark.createDataFrame([(1,), (9,)], "code int")
    assert {r.code: r.value for r in dictionary.reverse(back, "code", more).collect()} == {1: "b", 9: None}
    assert tuple(dictionary.stats(more).first()) == (3, 4)
    assert tuple(dictionary.stats(more.limit(0)).first()) == (0, 1)
    assert dictionary.copied(more, more.limit(0), "dict16", "dict16") is more
    for target, kind in ((more, "dict16"), (more.limit(0), "dict32")):
        with pytest.raises(ValueError):
            dictionary.copied(more, target, "dict16", kind)


def test_scans(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), (None, 3)], "kind string, id long")
    q = scans.Query(LAYOUT).set("kind", "a")
    assert (q.leading, q.prefix_length, q.satisfiable("id")) == (["kind"], 2, False)
    assert sorted(r.id for r in scans.scan(rows, q).collect()) == [1, 5]
    assert scans.scan(rows, scans.Query(LAYOUT).set("id", 5), up_to="id").count() == 0
    assert [r.id for r in scans.scan(rows, scans.Query(LAYOUT).set("kind", None)).collect()] == [3]
    assert scans.scan(rows, scans.Query(LAYOUT).set("kind", "never")).count() == 0
    assert [r.id for r in scans.scan_all(rows, ["id"]).collect()] == [1, 3, 5, 9]
    assert q.clear().leading == []


def test_ids_and_times(spark):
    texts = ["12", " 7 ", "0", "-3", "x", None, str(2**64 - 1), str(2**64)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(cells.unsigned_id(F.col("s"))).collect()]
    assert got == [12, 7, None, None, None, None, 2**64 - 1, None]


def test_ingest_round_trip(spark):
    schema = "id long, a int, b double, c string, d array<string>, e boolean, f binary, g float, t timestamp_ntz"
    import datetime

    when = datetime.datetime(2020, 1, 2, 3, 4, 5, 678000)
    rows = [(1, 5, -0.0, "x", ["a", None, 'q"\n'], True, b"\0", 1.5, when), (2, None, None, None, [], None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    names = ["a", "b", "c", "d", "e", "f", "g", "t"]
    ops = cells.unpivot(df, ["id"], names, F.col("id"), cells.event_time(F.col("t"), df.schema["t"].dataType)).persist()
    assert ops.where("id = 2").count() == 1 and ops.where("id = 2").first().ts == 0
    again = cells.rebuilt(ops.select("id", "attr", "value"), ["id"], df.schema, names)
    assert tuple(cells.mismatches(df, again, ["id"], names).first()) == (2, 16, 0)
    wrong = again.withColumn("c", F.lit("other"))
    assert cells.mismatches(df, wrong, ["id"], names).first().n_mismatches == 2
    assert cells.schema_from_text(cells.schema_text(df.schema)) == df.schema
    assert ("d", "string", True) in cells.leaves(df.schema)


def key(n):
    return {"kind": "k", "id": n}


def test_store_lifecycle(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    with Store.create(spark, root, LAYOUT) as store:
        with store.write() as w:
            w.put(key(1), "age", 30, 10)
            w.put(key(1), "name", "Ann")
            w.put_all(key(2), {"age": None, "raw": b"x"}, 5)
            w.put_all(key(2), None)
        before = store.read()
        with store.write() as w:
            w.put(key(1), "age", 31, 20)
            assert w.delete(key(1), "age", 25)
            assert not w.delete(key(9))
            assert not w.delete(key(9), "age")
        assert before.get(key(1), "age").i == 30  # pinned
        with store.read() as r:
            assert r.get(key(1), "age") is None and r.get_at(key(1), "age", 22).i == 31
            assert r.get(key(1), "name").s == "Ann"
            assert r.get(key(2), "age").tag == V.NULL and r.get(key(2), "none") is None
            assert sorted(r.get_all(key(2))) == ["age", "raw"] and sorted(r.get_all_at(key(1), 12)) == ["age", "name"]
            assert [x.is_tombstone for x in r.history(key(1), "age")] == [False, False, True]
            assert len(r.history_range(key(1), "age", 12, 22)) == 2
            seen = []
            assert r.for_each(lambda row: seen.append(row.id)) and seen == [1, 2]
            assert not r.for_each(lambda row: False)
            assert r.size() == 2 and not r.is_empty()
        store.compact()
        with store.write() as w:
            assert w.delete(key(1), "name") and w.delete(key(2))
        with store.read() as r:
            assert r.get(key(1), "name") is None and len(r.history(key(1), "name")) == 1 and r.size() == 1
        assert store.bytes()["observations"] > 0
    with pytest.raises(Closed):
        store.read()
    with pytest.raises(Closed):
        r.get(key(1), "age")
    again = Store.open(spark, root)
    assert again.layout == LAYOUT and again.reading(lambda r: r.get_at(key(1), "age", 22).i) == 31
    with pytest.raises(LayoutMismatch):
        Store.open(spark, root, K.KeyLayout.of(kind="dict16", id="uint16"))
    with pytest.raises(FileNotFoundError):
        Store.open(spark, root + "-none")
    with pytest.raises(FileExistsError):
        Store.create(spark, root, LAYOUT)


def test_store_errors_and_copy(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/a", LAYOUT)
    for bad, what in ((("k", "x" * 70_000, 1), "payload"), (("k", 1, -1), "1970"), ((None, 1, 1), "attribute")):
        with pytest.raises(ValueError, match=what), store.write() as w:
            w.put(key(1), bad[0], bad[1], bad[2])
    with pytest.raises(ValueError, match="fields"), store.write() as w:
        w.put({"id": 1}, "a", 1)
    assert store.commits() == []
    store.writing(lambda w: w.put(key(1), "a", 1, 5))
    store.writing(lambda w: w.put(key(1), "a", 2, 3))
    other = Store.create(spark, f"file://{tmp_path}/b", LAYOUT)
    other.copy_from(store.read())
    mine, theirs = (sorted((x.first_seen, x.value.i) for x in s.read().history(key(1), "a")) for s in (store, other))
    assert mine == theirs == [(3, 2), (5, 1)]
    with pytest.raises(ValueError):
        other.copy_from(store.read())


def test_store_conflict_and_recovery(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    one, two = Store.create(spark, root, LAYOUT), Store.open(spark, root)
    a, b = one.write(), two.write()
    a.put(key(1), "a", 1, 5)
    b.put(key(1), "b", 2, 5)
    b.close()
    a.close()  # behind b's
    assert sorted(one.read().get_all(key(1))) == ["a", "b"]
    assert sorted(r.seq for r in one.operations().collect()) == [0, 1]
    # A manifest that was cut short and a folder without one are ignored.
    (tmp_path / "c/_commits/000000000002.json").write_text('{"commit": {"n": 2')
    (tmp_path / "c/observations/orphan").mkdir()
    assert len(Store.open(spark, root).commits()) == 2
    assert Store.open(spark, root).vacuum() == ["orphan"]


def test_store_writes_after_a_torn_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "PATIENCE", 0.2)
    store = Store.create(spark, f"file://{tmp_path}/t", LAYOUT)
    store.writing(lambda w: w.put(key(1), "a", 1, 5))
    (tmp_path / "t/_commits/000000000001.json").write_text('{"commit": {"n": 1')
    again = Store.open(spark, f"file://{tmp_path}/t")
    again.writing(lambda w: w.put(key(1), "a", 2, 6))
    again.writing(lambda w: w.put(key(1), "b", 3, 6))
    assert len(again.commits()) == 3 and len(list((tmp_path / "t/_torn").iterdir())) >= 1
    assert {k: v.i for k, v in Store.open(spark, f"file://{tmp_path}/t").read().get_all(key(1)).items()} == {"a": 2, "b": 3}
    # Spoilt in the middle: nothing may be written or deleted.
    (tmp_path / "t/_commits/000000000001.json").write_text("{}")
    for work in (lambda s: s.writing(lambda w: w.put(key(1), "a", 4, 7)), lambda s: s.vacuum(), lambda s: s.compact()):
        with pytest.raises(Damaged):
            work(Store.open(spark, f"file://{tmp_path}/t"))
    assert len(list((tmp_path / "t/observations").iterdir())) >= 3
    monkeypatch.setattr(stores, "TRIES", 2)
    monkeypatch.setattr(stores.Files, "create", lambda *_: False)
    for n in (1, 2):
        (tmp_path / f"t/_commits/{n:012d}.json").unlink()
    with pytest.raises(TimeoutError):
        Store.open(spark, f"file://{tmp_path}/t")._publish(lambda done: {})


def test_write_scope_sees_its_own_operations(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/w", LAYOUT)
    with store.write() as w:
        assert w.is_empty()
        assert w.put(key(1), "a", 1, 100, report=True) and not w.put(key(1), "a", 1, 200, report=True)
        assert w.put(key(1), "a", 2, 150, report=True) and w.put(key(1), "a", 1, 50, report=True)
        w.put(key(2), "a", 1)
        assert w.size() == 2 and w.delete(key(2)) and not w.delete(key(2)) and w.size() == 1
        assert w.delete(key(1), "a") and not w.delete(key(1), "a") and w.size() == 1
    with store.write() as w:
        assert not w.delete(key(1), "a") and not w.delete(key(2))
        assert not w.put(key(1), "a", 2, 150, report=True)
        assert w.delete(key(1)) and not w.delete(key(1), "a")
    assert store.read().is_empty()


def test_stored_runs_are_what_the_log_gives(spark, tmp_path):
    rng = random.Random(4)
    for mode in ("canonical", "arrival"):
        store = Store.create(spark, f"file://{tmp_path}/{mode}", LAYOUT, mode)

        def some(w, n=25):
            for _ in range(n):
                kind = rng.random()
                own = key(rng.randint(1, 4))
                if kind < 0.8:
                    w.put(own, rng.choice("ab"), rng.randint(1, 2), rng.randint(1, 30))
                else:
                    w._add(own, *(("a", "CLEAR", None, 0) if kind < 0.93 else (None, "DROP", None, 0)))

        store.writing(some)
        before = store.read()
        store.compact()
        store.writing(lambda w: some(w, 4))
        now, other = store.read(), store.read("arrival" if mode == "canonical" else "canonical")
        for scope in (before, store.read(mode), now, other):
            show = lambda df: sorted(str(r) for r in df.select("kind", "id", "attr", *stores.RUN).collect())
            assert show(scope.runs) == show(scope._made(scope.live))
        for n in (1, 3):
            assert now.get_all(key(n)) == {r.attr: r.value for r in now._of(now._made(now.live), key(n)).where(f"valid_to = {2**63 - 1} and not cleared and not is_tombstone").collect()}
        store.compact()
        plan = store.read().runs_of(key(1)).where("first_seen <= 7 and valid_to >= 7 and attr = 'a'")._jdf.queryExecution().executedPlan().toString()
        pushed = next(x for x in plan.split("\n") if "PushedFilters" in x)
        assert "Exchange" not in plan and all(c in pushed for c in ("first_seen", "valid_to", "attr", "id"))
        assert Store.open(spark, f"file://{tmp_path}/{mode}").mode == mode and store.vacuum() == []


def test_decimals_and_nested_cells(spark):
    schema = "id long, d decimal(20,4), s struct<x:int,y:array<string>>, m map<string,int>, l array<struct<k:string>>"
    rows = [(1, Decimal("12345678901234.5000"), (3, ["a", None]), {"k": 1, "z": None}, [("q",), (None,)]), (2, None, None, None, None), (3, Decimal("-0.0001"), (None, None), {}, [])]
    df = spark.createDataFrame(rows, schema)
    names = ["d", "s", "m", "l"]
    ops = cells.unpivot(df, ["id"], names, F.col("id"), F.lit(0))
    again = cells.rebuilt(ops.select("id", "attr", "value").unionByName(spark.createDataFrame([(2, "d", None)], "id long, attr string, value " + V.VALUE.simpleString())), ["id"], df.schema, names)
    assert tuple(cells.mismatches(df, again, ["id"], names).first()) == (3, 12, 0)
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect()))


def test_streams(spark, tmp_path):
    schema = "seq long, id long, attr string, s string, ts long"
    rows = [(0, 1, "x", "A", 10), (1, 1, "x", "A", 20), (2, 1, "x", "B", 30), (3, 2, "x", "C", 5), (4, 1, "x", "D", 40)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    ops = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in").select("seq", "id", "attr", F.lit("PUT").alias("op"), V.string(F.col("s")).alias("value"), "ts")
    q = ingest.stream_changes(ops(), ["id"]).writeStream.format("memory").queryName("changes").option("checkpointLocation", f"{tmp_path}/cp1").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.first_seen, r.last_seen) for r in spark.table("changes").collect()) == [(10, 20), (30, 30)]
    store = Store.create(spark, f"file://{tmp_path}/s", K.KeyLayout.of(id="int64"))
    ingest.stream_to_store(ops(), store, f"{tmp_path}/cp2").awaitTermination()
    assert store.read().get({"id": 1}, "x").s == "D" and store.read().get_at({"id": 1}, "x", 25).s == "A"
    good, late = ingest.split_late(oplog.validated(store.operations(), ["id"])[0], 10)
    assert (good.count(), late.count()) == (4, 1)
    q = ingest.windowed_changes(ops(), ["id"], "10 seconds").writeStream.format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/cp3").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("n_ops")).first()[0] == 5


def test_runs_plan_has_one_exchange(spark):
    rows = spark.createDataFrame([(k, k % 3) for k in range(10)], "seq long, id long")
    df = rows.select("seq", "id", F.lit("x").alias("attr"), F.lit("PUT").alias("op"), V.int64(F.col("seq")).alias("value"), F.col("seq").alias("ts"))
    plan = runs.canonical_runs(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
