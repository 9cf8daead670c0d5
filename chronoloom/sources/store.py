"""The store: an append-only log of observations in Parquet, published by manifests.

A folder holds ``_schema.json`` (key layout and mode), ``observations/<name>/`` (operations), ``runs/<name>/`` (the runs of a
compacted log, sorted by key) and ``_commits/<n>.json``. A commit is visible from when its manifest exists; manifests
are created exclusively, so of two writers one wins and the other numbers its operations after the winner's and tries
again. Files without a manifest are leftovers of a crash and are ignored. A last manifest that a crash has cut short is moved
aside by the next writer, who gives its writer time first; each writer reads its manifest again before it counts as
published. A manifest that is spoilt in the middle is an error for writers. A reader is pinned to the commit at which it was
opened, and takes the runs of the last compaction up to it for all entities that no later commit names.

``mode`` says which runs are read: ``canonical`` (by time, whatever the order of arrival) or ``arrival`` (as the writers' rules leave
them, operation by operation). Files go through Hadoop's file system, so any store that Spark can write will do.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Callable
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.keys import KeyLayout
from ..operators import arrival, oplog, reads, runs, scans

#: Commits after which ``sync`` compacts.
COMPACT_EVERY = 64
#: How often a writer tries to publish, and how long it waits for another's manifest to become whole, in seconds.
TRIES, PATIENCE = 100, 2.0
MODES = ("canonical", "arrival")
#: What reads need of a run.
RUN = ["first_seen", "last_seen", "valid_to", "value", "is_tombstone", "cleared"]


class Files:
    """The few file operations that a store needs, by Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if it is there already."""
        try:
            stream = self.fs.create(self._path(name), False)
        except Exception as e:
            if "already exists" in str(e).lower():
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def move(self, name: str, to: str) -> None:
        self.fs.mkdirs(self._path(to).getParent())
        self.fs.rename(self._path(name), self._path(to))

    def bytes(self, folder: str) -> int:
        return self.fs.getContentSummary(self._path(folder)).getLength() if self.exists(folder) else 0

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class LayoutMismatch(ValueError):
    pass


class Closed(RuntimeError):
    pass


class Damaged(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, root: str, layout: KeyLayout, mode: str = "canonical") -> None:
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        self.spark, self.layout, self.mode, self.files, self.closed = spark, layout, mode, Files(spark, root), False
        self._whole: list[dict] = []  # manifests read so far; they never change

    @classmethod
    def create(cls, spark: SparkSession, root: str, layout: KeyLayout, mode: str = "canonical") -> Store:
        store = cls(spark, root, layout, mode)
        if not store.files.create("_schema.json", json.dumps({"layout": layout.fingerprint(), "mode": mode})):
            raise FileExistsError(root)
        return store

    @classmethod
    def open(cls, spark: SparkSession, root: str, layout: KeyLayout | None = None) -> Store:
        """Open; with ``layout``, only if it is the one that the store was created with."""
        files = Files(spark, root)
        if not files.exists("_schema.json"):
            raise FileNotFoundError(root)
        schema = json.loads(files.read("_schema.json"))
        own = KeyLayout.from_fingerprint(schema["layout"])
        if layout is not None and layout.fingerprint() != own.fingerprint():
            raise LayoutMismatch(f"the store's key is {own.fingerprint()}, not {layout.fingerprint()}")
        return cls(spark, root, own, schema.get("mode", "canonical"))

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("seq", T.LongType()), *self.layout.schema().fields, T.StructField("attr", T.StringType()), T.StructField("op", T.StringType()), T.StructField("value", V.VALUE), T.StructField("ts", T.LongType())])

    def _manifest(self, n: int) -> dict | None:
        try:
            body = json.loads(self.files.read(f"_commits/{n:012d}.json"))
            whole = body["check"] == zlib.crc32(json.dumps(body["commit"], sort_keys=True).encode()) and body["commit"]["n"] == n
        except (ValueError, KeyError, TypeError):
            return None
        except Py4JJavaError as e:
            if "ChecksumException" in str(e):  # the file system knows that the file is spoilt
                return None
            raise
        return body["commit"] if whole else None

    def commits(self) -> list[dict]:
        """Manifests that are whole, in order, up to the first gap. Those known by now are not read again."""
        n = len(self.files.names("_commits"))
        while len(self._whole) < n and self.files.exists(f"_commits/{len(self._whole):012d}.json") and (own := self._manifest(len(self._whole))) is not None:
            self._whole.append(own)
        return list(self._whole)

    def _check(self) -> list[dict]:
        """All commits; an error if whole manifests come after a gap, as nothing may be written or deleted then."""
        done = self.commits()
        numbers = [int(name.split(".")[0]) for name in self.files.names("_commits")]
        if any(n > len(done) and self._manifest(n) is not None for n in numbers):
            raise Damaged(f"commit {len(done)} is missing or spoilt, but later ones are there")
        return done

    def _publish(self, commit: Callable[[list[dict]], dict]) -> int:
        """Publish ``commit`` of the commits so far, behind whatever is published meanwhile; returns its number."""
        for _ in range(TRIES):
            done = self._check()
            n = len(done)
            name, own = f"_commits/{n:012d}.json", {"n": n} | commit(done)
            if self.files.create(name, json.dumps({"commit": own, "check": zlib.crc32(json.dumps(own, sort_keys=True).encode())})):
                if self._manifest(n) == own:
                    return n
                continue  # taken for a torn one, and moved
            began = time.time()
            while self.files.exists(name) and self._manifest(n) is None and time.time() - began < PATIENCE:
                time.sleep(PATIENCE / 10)
            if self.files.exists(name) and self._manifest(n) is None:
                self.files.move(name, f"_torn/{n:012d}-{uuid.uuid4().hex}.json")
        raise TimeoutError(f"other writers were first {TRIES} times")

    def append(self, ops: DataFrame) -> int:
        """Publish one batch of operations, atomically; their ``seq`` orders them within it. Returns the commit's number."""
        self._open()
        good, bad = oplog.validated(ops, self.layout.names)
        first = bad.select("reason").first()
        if first is not None:
            raise ValueError(first.reason)
        folder = f"observations/{uuid.uuid4().hex}"
        cast = self.layout.cast(good).select([F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        cast.write.parquet(f"{self.files.root}/{folder}")
        span = self.spark.read.schema(self.schema).parquet(f"{self.files.root}/{folder}").agg(F.min("seq"), F.max("seq")).first()
        if span[0] is None:
            return len(self.commits()) - 1
        first, n = span[0], span[1] - span[0] + 1

        def commit(done: list[dict]) -> dict:
            base = done[-1]["next"] if done else 0
            return {"folder": folder, "shift": base - first, "next": base + n}

        return self._publish(commit)

    def operations(self, commit: int | None = None, since: int = -1) -> DataFrame:
        """The log up to a commit (all of it by default), or its part after the commit ``since``."""
        self._open()
        done = (self.commits() if commit is None else self.commits()[: commit + 1])[since + 1 :]
        rows = self.spark.createDataFrame([], self.schema)
        whole = max((k for k, c in enumerate(done) if "all" in c), default=None)
        if whole is not None:
            rows = self.spark.read.schema(self.schema).parquet(f"{self.files.root}/{done[whole]['all']}")
        for c in done if whole is None else done[whole + 1 :]:
            part = self.spark.read.schema(self.schema).parquet(f"{self.files.root}/{c['folder']}")
            rows = rows.unionByName(part.withColumn("seq", F.col("seq") + c["shift"]))
        return rows

    def read(self, mode: str | None = None) -> ReadScope:
        self._open()
        return ReadScope(self, len(self.commits()) - 1, mode or self.mode)

    def write(self) -> WriteScope:
        self._open()
        return WriteScope(self)

    def reading(self, work: Callable[[ReadScope], object]) -> object:
        with self.read() as r:
            return work(r)

    def writing(self, work: Callable[[WriteScope], object]) -> object:
        with self.write() as w:
            return work(w)

    def compact(self) -> None:
        """Rewrite the log as one folder and store the runs of the store's mode, both sorted by key; earlier readers keep their files."""
        self._open()
        done = self._check()
        if not done:
            return
        name, keys = uuid.uuid4().hex, self.layout.names
        upto = ReadScope(self, len(done) - 1, self.mode)
        upto.operations.repartitionByRange(*keys, "attr", "ts").sortWithinPartitions(*keys, "attr", "ts").write.parquet(f"{self.files.root}/observations/{name}")
        runs.compacted(upto.runs, keys).write.parquet(f"{self.files.root}/runs/{name}")
        if len(self.commits()) > len(done):
            return  # others were at work meanwhile; the next compaction takes this place
        self._publish(lambda now: {"replaces": len(done), "all": f"observations/{name}", "runs": f"runs/{name}", "mode": self.mode, "next": done[-1]["next"]} if len(now) == len(done) else {"folder": f"observations/{self._nothing()}", "shift": 0, "next": now[-1]["next"]})

    def _nothing(self) -> str:
        """A folder without operations, for a commit that turned out to be empty."""
        name = uuid.uuid4().hex
        self.spark.createDataFrame([], self.schema).write.parquet(f"{self.files.root}/observations/{name}")
        return name

    def sync(self) -> None:
        """Commits are durable when published; every ``COMPACT_EVERY`` of them the log is compacted."""
        self._open()
        since = 0
        for c in self.commits():
            since = 0 if "all" in c else since + 1
        if since >= COMPACT_EVERY:
            self.compact()

    def copy_from(self, source: ReadScope) -> None:
        """Take over another store's operations as they are; the store must be empty and of the same layout."""
        if self.layout.fingerprint() != source.store.layout.fingerprint():
            raise LayoutMismatch("stores of different layouts")
        if self.commits():
            raise ValueError("the target store is not empty")
        self.append(source.operations)

    def bytes(self) -> dict[str, int]:
        return {k: self.files.bytes(k) for k in ("observations", "runs", "_commits")}

    def vacuum(self) -> list[str]:
        """Delete folders that no manifest names: leftovers of writers that died. No writer may be at work; a damaged log is left alone."""
        named = {c[k] for c in self._check() for k in ("folder", "all", "runs") if k in c}
        gone = [f"{top}/{n}" for top in ("observations", "runs") for n in self.files.names(top) if f"{top}/{n}" not in named]
        for name in gone:
            self.files.delete(name)
        return [name.split("/")[1] for name in gone]

    def close(self) -> None:
        if not self.closed:
            self.sync()
            self.closed = True

    def _open(self) -> None:
        if self.closed:
            raise Closed("the store is closed")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class ReadScope:
    """A snapshot; all reads are of one commit."""

    def __init__(self, store: Store, commit: int, mode: str) -> None:
        self.store, self.commit, self.mode, self.keys, self.closed = store, commit, mode, store.layout.names, False

    def _open(self) -> None:
        if self.closed:
            raise Closed("the scope is closed")

    @property
    def operations(self) -> DataFrame:
        self._open()
        return self.store.operations(self.commit)

    @property
    def live(self) -> DataFrame:
        return oplog.since_drop(self.operations, self.keys)

    def _of(self, df: DataFrame, key: dict) -> DataFrame:
        for k, v in key.items():
            df = df.where(F.col(k).eqNullSafe(F.lit(v)))
        return df

    def _made(self, live: DataFrame) -> DataFrame:
        """Runs from operations, each with whether a CLEAR has taken its attribute out of the current view."""
        by = [*self.keys, "attr"]
        own = arrival.arrival_runs(live, self.keys) if self.mode == "arrival" else runs.canonical_runs(live, self.keys)
        gone = reads.cleared(live, self.keys).select(*[F.col(c).alias(f"_c_{c}") for c in by], F.lit(True).alias("cleared"))
        joined = own.join(gone, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in by], "left")
        return joined.select(*by, *RUN[:-1], F.coalesce("cleared", F.lit(False)).alias("cleared"))

    def _later(self) -> tuple[dict | None, DataFrame]:
        """(the last compaction up to this commit that holds runs of this mode, the operations after it)."""
        done = self.store.commits()[: self.commit + 1]
        at = max((k for k, c in enumerate(done) if c.get("runs") and c["mode"] == self.mode), default=None)
        return (None, self.operations) if at is None else (done[at], self.store.operations(self.commit, at))

    def runs_of(self, key: dict | None = None) -> DataFrame:
        """The runs of one entity, or of all. Stored ones are read as they are, so filters reach the files."""
        self._open()
        base, later = self._later()
        pick = (lambda df: df) if key is None else (lambda df: self._of(df, key))
        if base is None:
            return self._made(oplog.since_drop(pick(self.operations), self.keys))
        kinds = [*self.store.layout.schema().fields, T.StructField("attr", T.StringType()), *(T.StructField(c, V.VALUE if c == "value" else T.BooleanType() if c in RUN[-2:] else T.LongType()) for c in RUN)]
        stored = pick(self.store.spark.read.schema(T.StructType(kinds)).parquet(f"{self.store.files.root}/{base['runs']}"))
        if base["n"] == self.commit:
            return stored
        # Entities that later commits name are made anew from their operations.
        touched = pick(later).select(*[F.col(k).alias(f"_k_{k}") for k in self.keys]).distinct()
        if key is not None:
            return stored if touched.isEmpty() else self._made(oplog.since_drop(pick(self.operations), self.keys))
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys]
        return stored.join(touched, same, "left_anti").unionByName(self._made(oplog.since_drop(self.operations.join(touched, same, "left_semi"), self.keys)))

    @property
    def runs(self) -> DataFrame:
        return self.runs_of()

    def get(self, key: dict, attr: str):
        """The latest value as a row (tag, i, f, s, b), None if there is none."""
        row = reads.get_latest(self.runs_of(key).where("not cleared"), self.keys, attr=attr).select("value").first()
        return row and row.value

    def get_at(self, key: dict, attr: str, ts: int):
        row = reads.get_at(self.runs_of(key), ts, attr).select("value").first()
        return row and row.value

    def get_all(self, key: dict) -> dict:
        return {r.attr: r.value for r in reads.get_latest(self.runs_of(key).where("not cleared"), self.keys).select("attr", "value").collect()}

    def get_all_at(self, key: dict, ts: int) -> dict:
        return {r.attr: r.value for r in reads.get_at(self.runs_of(key), ts).select("attr", "value").collect()}

    def history(self, key: dict, attr: str) -> list:
        return reads.history(self.runs_of(key), self.keys, attr).collect()

    def history_range(self, key: dict, attr: str, start: int, end: int) -> list:
        return reads.history_range(self.runs_of(key), start, end, attr).orderBy("first_seen").collect()

    def scan(self, query: scans.Query | None = None, up_to: str | None = None) -> DataFrame:
        found = scans.entities(self.live, self.keys)
        return found if query is None else scans.scan(found, query, up_to)

    def for_each(self, visit: Callable, query: scans.Query | None = None) -> bool:
        """Call ``visit`` on keys in order until it returns False; True if it never does. Rows come one partition at a time."""
        for row in self.scan(query).orderBy(*self.keys).toLocalIterator():
            if visit(row) is False:
                return False
        return True

    def size(self) -> int:
        return scans.entities(self.live, self.keys).count()

    def is_empty(self) -> bool:
        return scans.entities(self.live, self.keys).isEmpty()

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> ReadScope:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class WriteScope:
    """A batch of operations that becomes visible at once, when the scope ends without an error."""

    def __init__(self, store: Store) -> None:
        self.store, self.closed = store, False
        self.rows: list[tuple] = []
        self.tables: list[DataFrame] = []

    def _add(self, key: dict, attr: str | None, kind: str, value: tuple | None, ts: int) -> None:
        if self.closed:
            raise Closed("the scope is closed")
        if key is None or set(key) != set(self.store.layout.names):
            raise ValueError("a key needs all fields of the layout")
        if kind != "DROP" and attr is None:
            raise ValueError("no attribute")
        if ts < 0:
            raise ValueError("time is null or before 1970")
        payload = value and (value[3].encode() if value[3] is not None else value[4])
        if payload is not None and len(payload) > V.MAX_PAYLOAD:
            raise ValueError("payload over 65535 bytes")
        self.rows.append((len(self.rows), *(key[n] for n in self.store.layout.names), attr, kind, value, ts))

    def _batch(self) -> DataFrame:
        schema = self.store.schema
        return self.store.spark.createDataFrame([_cast(r, schema) for r in self.rows], schema)

    def view(self) -> ReadScope:
        """What a reader would see if the operations put one by one so far were published now."""
        return _View(self)

    def put(self, key: dict, attr: str, value: object, ts: int = oplog.TIMELESS, report: bool = False) -> bool | None:
        """With ``report``, whether the state changes: not if the run that holds at ``ts`` has the value already. This reads the store."""
        changed = None
        if report:
            at = self.view()
            before = arrival.arrival_runs(at._of(at.live, key).where(F.col("attr") == attr), at.keys).where(F.col("first_seen") <= ts).orderBy(F.desc("first_seen"))
            own = self.store.spark.createDataFrame([(plain(value),)], T.StructType([T.StructField("value", V.VALUE)]))
            last = before.limit(1).select(V.comparison_key(F.col("value")).alias("v")).unionByName(own.select(V.comparison_key(F.col("value")).alias("v"))).collect()
            changed = len(last) < 2 or last[0].v != last[1].v
        self._add(key, attr, "PUT", plain(value), ts)
        return changed

    def size(self) -> int:
        return self.view().size()

    def is_empty(self) -> bool:
        return self.view().is_empty()

    def put_all(self, key: dict, attributes: dict | None, ts: int = oplog.TIMELESS) -> None:
        if key is None:
            raise ValueError("a key needs all fields of the layout")
        for attr, value in (attributes or {}).items():
            self.put(key, attr, value, ts)

    def delete(self, key: dict, attr: str | None = None, ts: int | None = None) -> bool:
        """The entity with all history; or an attribute's current value; or, with a time, a tombstone. Whether there was anything to delete."""
        now = self.view()
        if attr is not None and ts is None:
            there = now.get(key, attr) is not None
        else:
            there = not scans.entities(now._of(now.live, key), now.keys).isEmpty()
        if attr is None:
            if there:
                self._add(key, None, "DROP", None, 0)
        elif ts is None:
            if there:
                self._add(key, attr, "CLEAR", None, 0)
        else:
            self._add(key, attr, "TOMB", (V.TOMBSTONE, None, None, None, None), ts)
        return there

    def append(self, ops: DataFrame) -> None:
        """Operations by the table, after those put one by one so far."""
        self.tables.append(ops)

    def close(self) -> None:
        if self.closed:
            return
        self.closed = True
        batch = self._batch() if self.rows else None
        for k, t in enumerate(self.tables):
            part = t.select([F.col(f.name) for f in self.store.schema.fields])
            # Each table comes behind what is there, whatever numbers its rows have.
            batch = part if batch is None else batch.unionByName(part.withColumn("seq", F.col("seq") + (1 << 40) * (k + 1)))
        if batch is not None:
            self.store.append(batch)

    def __enter__(self) -> WriteScope:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        if kind is None:
            self.close()
        self.closed = True


class _View(ReadScope):
    """The store as it is now with a write scope's own operations behind."""

    def __init__(self, scope: WriteScope) -> None:
        store = scope.store
        super().__init__(store, len(store.commits()) - 1, store.mode)
        self.scope, self.mine = scope, scope._batch() if scope.rows else None

    @property
    def operations(self) -> DataFrame:
        published = self.store.operations(self.commit)
        return published if self.mine is None else published.unionByName(self.mine.withColumn("seq", F.col("seq") + (1 << 60)))

    def runs_of(self, key: dict | None = None) -> DataFrame:
        if self.mine is None:
            return super().runs_of(key)
        return self._made(oplog.since_drop(self.operations if key is None else self._of(self.operations, key), self.keys))


def plain(value: object) -> tuple:
    """A Python value as a tagged one; a tuple of five is taken to be tagged already."""
    if isinstance(value, tuple) and len(value) == 5:
        return value
    if value is None:
        return (V.NULL, None, None, None, None)
    if isinstance(value, bool):
        return (V.BOOL, int(value), None, None, None)
    if isinstance(value, int):
        return (V.INT64, value, None, None, None)
    if isinstance(value, float):
        return (V.FLOAT64, None, value, None, None)
    if isinstance(value, str):
        return (V.STRING, None, None, value, None)
    if isinstance(value, (bytes, bytearray)):
        return (V.BYTES, None, None, None, bytearray(value))
    raise TypeError(f"no value type for {type(value).__name__}")


def _cast(row: tuple, schema: T.StructType) -> tuple:
    return tuple(Decimal(x) if isinstance(f.dataType, T.DecimalType) and x is not None else x for x, f in zip(row, schema.fields, strict=True))
