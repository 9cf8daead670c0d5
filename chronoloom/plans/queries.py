"""Queries over the test tables: E keys ``events`` by user, P keys ``customer`` by region, nation and segment, S ``orders`` by customer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.keys import KeyLayout
from ..operators import arrival, dictionary, oplog, reads, runs, scans, temporal_joins, versions
from ..sources import cells

#: Times of the as-of and range queries, in milliseconds: 2024-01-15, and 2024-01-10 to 2024-01-20.
AT, FROM, TO = 1_705_276_800_000, 1_704_844_800_000, 1_705_708_800_000
#: Nine hours after the first events.
EARLY = 1_704_100_000_000
E = ["user_id"]
P = KeyLayout.of(r_name="dict16", n_name="dict16", c_mktsegment="dict16", c_custkey="uint32")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def time_of(df: DataFrame, col: str) -> Column:
    return cells.event_time(F.col(col), df.schema[col].dataType)


def event_ops(spark: SparkSession, sf_dir: str, *attrs: str) -> DataFrame:
    """PUTs of the named attributes of each event; with one attribute, ``seq`` is the event's id."""
    ev = table(spark, sf_dir, "events")
    ts = time_of(ev, "ts")
    puts = {"event_type": V.string(F.col("event_type")), "value": V.float64(F.col("value")), "props": V.json(F.col("props"))}
    return oplog.log(ev, E, F.col("event_id"), *(oplog.put(a, puts[a], ts) for a in attrs))


def event_runs(spark: SparkSession, sf_dir: str, *attrs: str) -> DataFrame:
    return runs.canonical_runs(event_ops(spark, sf_dir, *(attrs or ("event_type", "value", "props"))), E)


def flat(df: DataFrame, *cols: str) -> DataFrame:
    """Columns and the value's parts, so that results have no structs."""
    return df.select(*cols, F.col("value.tag").cast("int").alias("tag"), F.col("value.f").alias("f"), F.col("value.s").alias("s"))


def runs_canonical(spark, d):
    return event_runs(spark, d, "event_type").select("user_id", "first_seen", "last_seen", "valid_to", F.col("value.s").alias("v"))


def history(spark, d):
    return flat(reads.history(event_runs(spark, d), E, ordered=False), "user_id", "attr", "first_seen", "last_seen", "valid_to", "is_tombstone")


def history_range(spark, d):
    return flat(reads.history_range(event_runs(spark, d), FROM, TO), "user_id", "attr", "first_seen", "last_seen", "valid_to")


def state_changes(spark, d):
    return runs.state_changes(event_ops(spark, d, "event_type"), E).select(F.col("seq").alias("event_id"), "user_id", "changed")


def get_latest(spark, d):
    return flat(reads.get_latest(event_runs(spark, d, "event_type"), E), "user_id", "attr")


def get_at(spark, d):
    return flat(reads.get_at(event_runs(spark, d, "event_type"), AT), "user_id", "attr", "first_seen", "valid_to")


def asof_batch(spark, d):
    ev = table(spark, d, "events")
    probes = ev.select("user_id", F.lit("event_type").alias("attr"), (time_of(ev, "ts") - 86_400_000).alias("ts"), "event_id")
    return reads.asof_batch(event_runs(spark, d, "event_type"), probes, E).select("event_id", "user_id", F.col("ts").alias("probe_ts"), F.col("value.s").alias("v"))


def neighbours(spark, d):
    return reads.neighbours(event_runs(spark, d, "event_type"), E, AT)


def _event_log(spark, d, error: Callable[[Column], Column]) -> DataFrame:
    ev = table(spark, d, "events")
    ts = time_of(ev, "ts")
    put = oplog.put("event_type", V.string(F.col("event_type")), ts)
    return oplog.log(ev, E, F.col("event_id"), F.when(F.col("event_type") == "error", error(ts)).otherwise(put))


def tombstone_asof(spark, d):
    ops = _event_log(spark, d, lambda ts: oplog.tomb("event_type", ts))
    return flat(reads.get_at(runs.canonical_runs(ops, E), AT), "user_id", "attr")


def clear_attr(spark, d):
    ops = _event_log(spark, d, lambda _: oplog.clear("event_type"))
    return flat(reads.get_latest(runs.canonical_runs(ops, E), E, ops), "user_id", "attr")


def delete_entity(spark, d):
    """A signup drops the user and all that came before."""
    ev = table(spark, d, "events")
    put = oplog.put("event_type", V.string(F.col("event_type")), time_of(ev, "ts"))
    ops = oplog.log(ev, E, F.col("event_id"), F.when(F.col("event_type") == "signup", oplog.drop()).otherwise(put))
    return flat(runs.canonical_runs(oplog.since_drop(ops, E), E), "user_id", "attr", "first_seen", "last_seen", "valid_to")


def timeless_mix(spark, d):
    """Timeless segments of customers under the events of the user with the same number, early on."""
    cust, ev = table(spark, d, "customer"), table(spark, d, "events")
    timeless = oplog.log(cust.select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), E, F.col("user_id") - (1 << 40), oplog.put("state", V.string(F.col("c_mktsegment"))))
    timed = oplog.log(ev, E, F.col("event_id"), oplog.put("state", V.string(F.col("event_type")), time_of(ev, "ts")))
    return flat(reads.get_at(runs.canonical_runs(timeless.unionByName(timed), E), EARLY), "user_id", "attr", "first_seen")


def _exploded(maps: DataFrame, *cols: str) -> DataFrame:
    return flat(maps.select(*cols, F.explode("state").alias("attr", "value")), *cols, "attr")


def get_all(spark, d):
    return _exploded(reads.get_all(event_runs(spark, d), E), "user_id")


def get_all_at(spark, d):
    return _exploded(reads.get_all_at(event_runs(spark, d), E, AT), "user_id")


def versions_(spark, d):
    return _exploded(versions.versions(event_runs(spark, d), E), "user_id", "first_seen", "valid_to")


def compact_noop(spark, d):
    return runs.compacted(event_runs(spark, d, "event_type"), E).select("user_id", "first_seen", "last_seen", "valid_to", F.col("value.s").alias("v"))


def scan_overlap(spark, d):
    return flat(temporal_joins.scan_overlap(event_runs(spark, d), FROM, TO), "user_id", "attr", "first_seen", "last_seen", "valid_to")


def ext_interval_join(spark, d):
    joined = temporal_joins.interval_join(event_runs(spark, d, "event_type", "props"), E, "event_type", "props")
    return joined.select("user_id", "overlap_from", "overlap_to", F.col("left_value.s").alias("event_type"), F.col("right_value.s").alias("props"))


def ext_time_weighted(spark, d):
    return flat(temporal_joins.time_weighted(event_runs(spark, d, "event_type"), E, FROM, TO), "user_id", "duration_ms")


def customers(spark, d) -> DataFrame:
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("r_name", "n_name", "c_mktsegment", "c_custkey")


def _dictionaries(rows: DataFrame) -> dict[str, DataFrame]:
    return {f.name: dictionary.intern(rows, f.name, F.col("c_custkey"), kind=f.kind) for f in P.fields if f.is_dictionary}


def coded_customers(spark, d) -> DataFrame:
    rows = customers(spark, d)
    for name, own in _dictionaries(rows).items():
        rows = dictionary.resolve(rows, name, own, f"{name}_code")
    return rows


def scan_all(spark, d):
    return scans.scan_all(coded_customers(spark, d), ["r_name_code", "n_name_code", "c_mktsegment_code", "c_custkey"])


def scan_prefix_1(spark, d):
    return scans.scan(customers(spark, d), scans.Query(P).set("r_name", "ASIA"))


def scan_prefix_2(spark, d):
    return scans.scan(customers(spark, d), scans.Query(P).set("r_name", "ASIA").set("n_name", "NATION_7"), up_to="n_name")


def scan_unsat(spark, d):
    """The nation is set but not the region before it: nothing can be found."""
    return scans.scan(customers(spark, d), scans.Query(P).set("n_name", "NATION_7"), up_to="n_name")


def scan_bytes(spark, d):
    """First region, nation and segment, and the first two bytes of the customer's number."""
    keyed = coded_customers(spark, d).withColumn("key", P.encode())
    return scans.scan_bytes(keyed, "key", bytes.fromhex("0001000100010000")).select("c_custkey", F.hex("key").alias("key_hex"))


def _customer_ops(spark, d) -> DataFrame:
    return oplog.log(customers(spark, d), P.names, F.col("c_custkey"), oplog.put("seen", V.boolean(F.lit(True))))


def size(spark, d):
    return scans.size(oplog.since_drop(_customer_ops(spark, d), P.names), P.names)


def stats(spark, d):
    rows = customers(spark, d)
    n = scans.entities(_customer_ops(spark, d), P.names).agg(F.count(F.lit(1)).alias("n_entities"))
    parts = [dictionary.stats(own).select(F.lit(name).alias("field"), "size", "next_code") for name, own in _dictionaries(rows).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(F.broadcast(n), F.lit(True))  # one row


def scan_prefix_first(spark, d):
    """What a shell shows of a prefix: its first 20 keys in order, and how many there are."""
    found = scans.scan(customers(spark, d), scans.Query(P).set("r_name", "ASIA"))
    return scans.first_and_count(found, P.names, 20)


def stats_samples(spark, d):
    """The first five entities."""
    return scans.first_and_count(scans.entities(_customer_ops(spark, d), P.names), P.names, 5)


def dict_attributes(spark, d):
    return dictionary.attributes(event_ops(spark, d, "value", "event_type", "props"))


def dict_build(spark, d):
    out = None
    for name, own in _dictionaries(customers(spark, d)).items():
        part = own.select(F.lit(name).alias("field"), "value", "code")
        out = part if out is None else out.unionByName(part)
    return out


def dict_resolve(spark, d):
    """Suppliers' nations by a dictionary of customers' nations that are strings of it, and two strings that are not."""
    own = dictionary.intern(customers(spark, d), "n_name", F.col("c_custkey"), kind="dict16")
    nations = table(spark, d, "nation").select("n_name").unionByName(spark.createDataFrame([("ATLANTIS",), (None,)], "n_name string"))
    return dictionary.resolve(nations, "n_name", own)


def dict_reverse(spark, d):
    own = dictionary.intern(customers(spark, d), "c_mktsegment", F.col("c_custkey"), kind="dict16")
    return dictionary.reverse(spark.range(0, 8).select(F.col("id").cast("int").alias("code")), "code", own)


ORDER_ATTRS = ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def order_cells(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return cells.unpivot(o, ["o_orderkey"], ORDER_ATTRS, F.col("o_orderkey"), time_of(o, "o_orderdate"))


def ingest_cells(spark, d):
    return order_cells(spark, d).select("o_orderkey", "attr", "ts", F.col("value.tag").cast("int").alias("tag"), F.col("value.i").alias("i"), F.col("value.f").alias("f"), F.col("value.s").alias("s"))


def json_roundtrip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.array("lang", F.lit(None), "source", F.lit('a "quote"')).alias("many"), F.array().cast("array<string>").alias("none"))
    made = docs.select("doc_id", "many", cells.json_array("many").alias("json"), cells.json_array("none").alias("empty_json"))
    back = cells.from_json_array("json")
    return made.select("doc_id", "json", "empty_json", F.size(back).cast("bigint").alias("n"), back[1].isNull().alias("null_kept"), (back == F.col("many")).alias("same"))


def roundtrip_verify(spark, d):
    o = table(spark, d, "orders")
    live = reads.get_latest(runs.canonical_runs(order_cells(spark, d), ["o_orderkey"]), ["o_orderkey"])
    return cells.mismatches(o, cells.rebuilt(live, ["o_orderkey"], o.schema, ORDER_ATTRS), ["o_orderkey"], ORDER_ATTRS)


def status_ops(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return oplog.log(o, ["o_custkey"], F.col("o_orderkey"), oplog.put("status", V.string(F.col("o_orderstatus")), time_of(o, "o_orderdate")))


def runs_arrival(spark, d):
    return arrival.arrival_runs(status_ops(spark, d), ["o_custkey"]).select("o_custkey", "first_seen", "last_seen", "valid_to", F.col("value.s").alias("v"))


def copy_replay(spark, d):
    own = arrival.arrival_runs(status_ops(spark, d), ["o_custkey"])
    return arrival.copy_replay(own, ["o_custkey"]).select("o_custkey", "first_seen", "last_seen", "valid_to", F.col("value.s").alias("v"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__.rstrip("_"): f
    for f in (
        runs_canonical, history, history_range, state_changes, get_latest, get_at, asof_batch, neighbours, tombstone_asof, timeless_mix, clear_attr, delete_entity,
        get_all, get_all_at, versions_, scan_all, scan_prefix_1, scan_prefix_2, scan_unsat, scan_bytes, size, stats, scan_prefix_first, stats_samples, dict_attributes, dict_build, dict_resolve, dict_reverse,
        ingest_cells, json_roundtrip, roundtrip_verify, runs_arrival, copy_replay, compact_noop, scan_overlap, ext_interval_join, ext_time_weighted,
    )
}
