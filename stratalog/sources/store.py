"""A store: immutable Parquet segments, a log of small commits, and a manifest of edits.

Readers use the files that the manifest names and nothing else, so a write is visible once its edit exists. Edits and
commits are files created only if absent, with consecutive names and a checksum: a commit is there whole or not at all,
and of two writers only one can make the next. One writer holds the store by a lease. Everything goes through Hadoop's
file system, so a store may lie wherever Spark can read. Small writes wait on the driver in a bounded buffer, as they
do in any log-structured store; bulk writes (``write_frame``) go straight to segments.

After any failure between the first change to storage and the end of a commit the store takes no more writes until it
is opened again; what was acknowledged is then found, once. Segments that a compaction replaces stay while a reader of
an older version lives, and for a time after that, as tables made by a reader may be run later.
"""

from __future__ import annotations

import base64
import functools
import json
import threading
import time
import uuid
import weakref
import zlib
from collections import deque
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.keys import found_at
from stratalog.model import DELETE, ENTRY, MAX_KEY, MAX_SEQ, MERGE, SET, SET_TTL, BatchTooLarge, Closed, Corruption, DoesNotExist, Exists, ForeignSnapshot, InvalidBatch, KeyTooLarge, NoMerger, NotFound, Options
from stratalog.operators import levels
from stratalog.operators.retention import flush_dedup, retain
from stratalog.operators.scan import Reader
from stratalog.plans import compaction as plan
from stratalog.plans.compaction import FileMeta
from stratalog.sources.batch import Batch
from stratalog.sources.files import Files
from stratalog.sources.lease import Lease

#: Bytes of batches that one log record takes, and ranges that a compaction looks keys up in.
GROUP_BYTES, MAX_RANGES = 1 << 20, 4096


def _b64(x: bytes | None) -> str | None:
    return None if x is None else base64.b64encode(x).decode()


def _bytes(x: str | None) -> bytes | None:
    return None if x is None else base64.b64decode(x)


def _packed(f: FileMeta) -> dict:
    return asdict(f) | {"smallest": _b64(f.smallest), "largest": _b64(f.largest)}


def _file(told: dict) -> FileMeta:
    return FileMeta(**told | {"smallest": _bytes(told["smallest"]), "largest": _bytes(told["largest"])})


def _decoded(name: str, record: dict) -> list[tuple]:
    """The operations of a log record, checked."""
    out = []
    for kind, key, value, expiry in record["ops"]:
        key, value = _bytes(key), _bytes(value)
        if kind not in (DELETE, SET, MERGE, SET_TTL) or key is None or len(key) > MAX_KEY or (kind == DELETE) != (value is None) or (kind == SET_TTL) != (expiry is not None):
            raise Corruption(f"log {name}: an operation contradicts itself")
        out.append((kind, key, value, expiry))
    if len(out) != record["count"]:
        raise Corruption(f"log {name}: {len(out)} operations of {record['count']}")
    return out


def _sealed(record: dict) -> str:
    body = json.dumps(record, sort_keys=True)
    return json.dumps({"crc": zlib.crc32(body.encode()), "body": body})


def _unsealed(text: str) -> dict | None:
    """The record, or None if it is damaged."""
    try:
        outer = json.loads(text)
        return json.loads(outer["body"]) if zlib.crc32(outer["body"].encode()) == outer["crc"] else None
    except (ValueError, KeyError, TypeError):
        return None


class Snapshot:
    """A pinned sequence number; releasing it twice does nothing."""

    def __init__(self, store: Store, seq: int) -> None:
        self.store, self.seq, self.created_at, self.released = store, seq, time.time(), False

    def release(self) -> None:
        self.released = True
        self.store.snapshots.discard(self)


class _Waiting:
    """A batch in the queue of writers."""

    def __init__(self, batch: Batch) -> None:
        self.batch, self.seq, self.error = batch, 0, None


def _locked(method: Callable) -> Callable:
    @functools.wraps(method)
    def run(self, *args, **more):
        with self.lock:
            return method(self, *args, **more)

    return run


class Store:
    """An ordered key-value store with versions. Keys, values and operands are bytes. Threads may share it.

    ``files``: how its folder is reached, for tests.
    """

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, files: Files | None = None) -> None:
        self.spark, self.options, self.files = spark, options or Options(), files or Files(spark, path)
        self.options.validate()
        self.closed, self.error = True, None
        self.lock, self.queue = threading.RLock(), deque()
        found = bool(self.files.list("manifest"))
        if found and self.options.error_if_exists:
            raise Exists(path)
        if not found and not self.options.create_if_missing:
            raise DoesNotExist(path)
        self.lease = Lease(self.files, self.options.lease_seconds)
        try:
            self.snapshots: set[Snapshot] = set()
            self.pins: dict[int, frozenset[int]] = {}
            self.memtable: list[tuple] = []
            self.unsynced: list[tuple] = []
            self.memtable_bytes, self._shown = 0, None
            self.version: dict[int, FileMeta] = {}
            #: When each file left the version, and the last batch of each stream.
            self.dropped: dict[int, float] = {}
            self.streams: dict[str, int] = {}
            self.last_seq = self.log_number = self.edit_number = self.folded_at = self.installs = 0
            self.next_file = 1
            self.pointers: dict[int, bytes] = {}
            self.counters = dict.fromkeys(("user_bytes", "flushes", "flush_bytes", "compactions", "compaction_bytes", "moves", "commits", "log_records", "log_bytes", "slowdowns", "stalls", "kept_operands"), 0)
            self._load()
            self._replay()
            self.closed = False
            if self.memtable:
                self._flush(MAX_SEQ)
            self._delete_obsolete()
        except Exception:
            self.closed = True
            try:
                self.lease.release()
            except Exception:  # noqa: BLE001  the first failure is the one to tell; the lease ends with its holder
                pass
            raise

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # manifest -------------------------------------------------------------------------------------------------------

    def _record(self, **more) -> dict:
        return {"comparer": self.options.comparer.name, "log_number": self.log_number, "next_file": self.next_file, "last_seq": self.last_seq, "deleted": [], "added": [], "at": time.time(), "streams": self.streams, "pointers": {str(k): _b64(v) for k, v in self.pointers.items()}} | more

    def _edit(self, added: list[FileMeta] = (), deleted: list[int] = (), pointers: dict[int, bytes] | None = None, **set_to) -> None:
        """Publish a new version: the file's creation is the commit. Nothing of this object changes before it.

        ``set_to``: new values of log_number, last_seq or streams.
        """
        gone = set(deleted)
        new = {k: f for k, f in self.version.items() if k not in gone}
        for f in added:
            if f.file_num in new:
                raise Corruption(f"file {f.file_num} twice")
            new[f.file_num] = f
        aims = self.pointers | (pointers or {})
        record = self._record(deleted=list(deleted), added=[_packed(f) for f in added], pointers={str(k): _b64(v) for k, v in aims.items()}, **set_to)
        try:
            self.files.create(f"manifest/{self.edit_number + 1:08d}.json", _sealed(record))
        except Exception as e:
            self.error = e
            raise
        self.edit_number += 1
        self.installs += 1
        self.dropped |= {n: record["at"] for n in gone if n not in new}
        self.version, self.pointers = new, aims
        for name, value in set_to.items():
            setattr(self, name, value)
        if self.edit_number - self.folded_at >= self.options.max_manifest_edits:
            self._fold()
        if self.options.paranoid_checks and self.installs % 8 == 0:
            self.check()

    def _fold(self) -> None:
        """One record for all edits so far; those before the last fold but one are deleted. A torn fold does no harm, as
        the edits after the fold before it are still there."""
        try:
            whole = self._record(added=[_packed(f) for f in self.version.values()], dropped=self.dropped)
            self.files.create(f"manifest/{self.edit_number:08d}.whole", _sealed(whole))
            for name in self.files.list("manifest"):
                if int(name.split(".")[0]) < self.folded_at:
                    self.files.delete(f"manifest/{name}")
        except Exception as e:
            self.error = e
            raise
        self.folded_at = self.edit_number

    def _apply(self, name: str, record: dict) -> None:
        if record["comparer"] != self.options.comparer.name:
            raise Corruption(f"comparer {record['comparer']}")
        self.edit_number = int(name.split(".")[0])
        for n in record["deleted"]:
            if self.version.pop(n, None):
                self.dropped[n] = record["at"]
        for f in record["added"]:
            self.version[f["file_num"]] = _file(f)
            self.dropped.pop(f["file_num"], None)
        self.dropped |= {int(k): v for k, v in record.get("dropped", {}).items()}
        self.log_number, self.next_file, self.last_seq, self.streams = record["log_number"], record["next_file"], record["last_seq"], record["streams"]
        self.pointers = {int(a): _bytes(b) for a, b in record["pointers"].items()}

    def _load(self) -> None:
        """The last whole record and the edits after it."""
        names = self.files.list("manifest")
        read = lambda name: _unsealed(self.files.read(f"manifest/{name}"))
        for name in reversed([n for n in names if n.endswith(".whole")]):
            if (record := read(name)) is not None:
                self._apply(name, record)
                self.folded_at = self.edit_number
                break
            self.files.delete(f"manifest/{name}")  # a fold that never ended
        edits = [n for n in names if n.endswith(".json") and int(n.split(".")[0]) > self.folded_at]
        for k, name in enumerate(edits):
            if (record := read(name)) is None:
                if k + 1 < len(edits):
                    raise Corruption(f"manifest {name}")
                self.files.delete(f"manifest/{name}")  # a commit that never ended
                break
            if int(name.split(".")[0]) != self.edit_number + 1:
                raise Corruption(f"no manifest record before {name}")
            self._apply(name, record)
        stored = set(self.files.list("data"))
        for f in self.version.values():
            if f"{f.file_num:08d}" not in stored:
                raise Corruption(f"segment {f.file_num} is missing")
        self.next_file = max([self.next_file, *(int(n) + 1 for n in stored if n.isdigit())])
        if not self.edit_number:
            self._edit()

    def _replay(self) -> None:
        """Commits since the last flush. From the first damaged record on the newest log is dropped; damage in an older
        one is an error unless recovery is to do its best."""
        names = [n for n in self.files.list("wal") if int(n.split(".")[0]) > self.log_number]
        for k, name in enumerate(names):
            self.next_file = max(self.next_file, int(name.split(".")[0]) + 1)
            record = _unsealed(self.files.read(f"wal/{name}"))
            if record is None:
                if k + 1 < len(names) and not self.options.best_effort_recovery:
                    raise Corruption(f"log {name}")
                self.files.delete(f"wal/{name}")
                continue
            ops = _decoded(name, record)
            if record["first_seq"] <= self.last_seq and ops:
                raise Corruption(f"log {name} is out of order")
            self._remember(record["first_seq"], ops)

    def _remember(self, first: int, ops: list[tuple]) -> None:
        self.memtable += [(key, first + i, kind, value, expiry) for i, (kind, key, value, expiry) in enumerate(ops)]
        self.last_seq = max(self.last_seq, first + len(ops) - 1)
        self._shown = None

    def _segment(self, number: int) -> str:
        return f"data/{number:08d}"

    # writes ---------------------------------------------------------------------------------------------------------

    def _usable(self) -> None:
        if self.closed:
            raise Closed
        if self.error:
            raise self.error

    def now(self) -> int:
        return self.options.clock() if self.options.clock else time.time_ns()

    def put(self, key: bytes, value: bytes, sync: bool = True) -> None:
        self.write(Batch().put(key, value), sync)

    def delete(self, key: bytes, sync: bool = True) -> None:
        self.write(Batch().delete(key), sync)

    def merge(self, key: bytes, operand: bytes, sync: bool = True) -> None:
        self.write(Batch().merge(key, operand), sync)

    def put_with_ttl(self, key: bytes, value: bytes, ttl_ns: int, sync: bool = True) -> None:
        self.write(Batch().put_with_expiry(key, value, self.now() + ttl_ns), sync)

    def write(self, batch: Batch | None, sync: bool = True) -> int:
        """Commit a batch whole or not at all; its last sequence number. An empty one takes none.

        Batches of several threads that wait for one another share a log record. Without ``sync`` a batch is visible
        at once and goes to the log with the next one that is synced, at GROUP_BYTES, at a flush or on closing; until
        then a crash loses it, and what was written after it.
        """
        self._usable()
        if batch is None:
            return self.last_seq
        batch.validate(self.options.merger)
        if not len(batch):
            return self.last_seq
        own = _Waiting(batch)
        self.queue.append(own)
        with self.lock:
            if not own.seq and not own.error:
                self._lead(own, sync)
            if own.error:
                raise own.error
            if self.memtable_bytes >= self.options.memtable_size:
                self.flush()
        return own.seq

    def _lead(self, own: _Waiting, sync: bool) -> None:
        """Commit the batches at the head of the queue, up to GROUP_BYTES but this one at least."""
        group, size = [], 0
        while self.queue and (own not in group or size + self.queue[0].batch.size() <= GROUP_BYTES):
            size += self.queue[0].batch.size()
            group.append(self.queue.popleft())
        try:
            self._usable()
            self._make_room()
            first = self.last_seq + 1
            ops = [op for w in group for op in w.batch.ops]
            self.unsynced += ops
            pending = sum(len(op[1]) + len(op[2] or b"") for op in self.unsynced)
            if sync or pending >= GROUP_BYTES:
                self._log(first + len(ops) - len(self.unsynced))
        except Exception as e:
            for w in group:
                w.error = e
            return
        self._remember(first, ops)
        at = first - 1
        for w in group:
            at += len(w.batch)
            w.seq = at
        self.memtable_bytes += size
        self.counters["user_bytes"] += size
        self.counters["commits"] += len(group)

    def _log(self, first: int) -> None:
        """Write the operations that no record has yet, the first with this sequence number."""
        if not self.unsynced:
            return
        number, self.next_file = self.next_file, self.next_file + 1
        text = _sealed({"first_seq": first, "count": len(self.unsynced), "ops": [(k, _b64(key), _b64(v), e) for k, key, v, e in self.unsynced]})
        try:
            self.files.create(f"wal/{number:08d}.json", text)
        except Exception as e:
            self.error = e
            raise
        self.unsynced = []
        self.counters["log_records"] += 1
        self.counters["log_bytes"] += len(text)

    def _make_room(self) -> None:
        """Writers wait where level 0 has too many runs: a moment from the slowdown on, for compactions from the stop."""
        if self.options.disable_automatic_compactions or (n := plan.zero_runs(list(self.version.values()))) < self.options.l0_slowdown_trigger:
            return
        if n < self.options.l0_stop_trigger:
            self.counters["slowdowns"] += 1
            time.sleep(0.001)
            return
        self.counters["stalls"] += 1
        while plan.zero_runs(list(self.version.values())) >= self.options.l0_stop_trigger and self.compact():
            pass

    @_locked
    def write_frame(self, ops: DataFrame, stream: tuple[str, int] | None = None) -> int:
        """Commit a table of operations (user_key, kind, value, expiry_ns, op_index) as one batch, written by executors.

        Sequence numbers follow op_index; nothing passes through the driver. All of it is checked before it is
        published: kinds and what belongs to them, lengths of keys, and that no op_index comes twice.
        ``stream``: a stream's name and the number of its batch, published in the same edit; a batch whose number the
        store has already had from that stream is not written again.
        """
        self._usable()
        if stream is not None and self.streams.get(stream[0], -1) >= stream[1]:
            return self.last_seq
        self.flush()
        kind = F.col("kind")
        fault = kind.isNull() | ~kind.isin(DELETE, SET, MERGE, SET_TTL) | F.col("user_key").isNull() | F.col("op_index").isNull() | ((kind == SET_TTL) != F.col("expiry_ns").isNotNull()) | ((kind != DELETE) & F.col("value").isNull())
        n, least, most, longest, merges, faults, places = ops.agg(F.count("*"), F.min("op_index"), F.max("op_index"), F.max(F.octet_length("user_key")), F.count(F.when(kind == MERGE, 1)), F.count(F.when(fault, 1)), F.count_distinct("op_index")).first()
        if faults:
            raise InvalidBatch(f"{faults} operations")
        if not n:
            if stream is not None:
                self._edit(streams=self.streams | {stream[0]: stream[1]})
            return self.last_seq
        if places < n:
            raise InvalidBatch("an op_index comes twice")
        if longest > MAX_KEY:
            raise KeyTooLarge(longest)
        if merges and self.options.merger is None:
            raise NoMerger("write")
        if most - least >= MAX_SEQ - self.last_seq:
            raise BatchTooLarge(n)
        self._make_room()
        rows = ops.select("user_key", (F.col("op_index") - F.lit(least) + F.lit(self.last_seq + 1)).cast("long").alias("seq"), kind.cast("byte").alias("kind"), F.when(kind != DELETE, F.col("value")).alias("value"), F.col("expiry_ns").cast("long").alias("expiry_ns"))
        added = self._write_segments(rows, 0)
        done = {} if stream is None else {"streams": self.streams | {stream[0]: stream[1]}}
        self._edit(added, last_seq=self.last_seq + most - least + 1, **done)
        self.counters["user_bytes"] += sum(f.key_bytes + f.value_bytes for f in added)
        self.counters["flush_bytes"] += sum(f.size for f in added)
        self._maybe_compact()
        return self.last_seq

    def _write_segments(self, rows: DataFrame, level: int, files: int | None = None, cuts: list[bytes] = ()) -> list[FileMeta]:
        """Segments of sorted rows by ranges of keys, all versions of a key in one; any failure ends the store's writes.

        ``files``: how many there are to be, else Spark chooses. ``cuts``: keys after which a segment ends.
        """
        try:
            return self._staged(rows, level, files, cuts)
        except Exception as e:
            self.error = e
            raise

    def _staged(self, rows: DataFrame, level: int, files: int | None, cuts: list[bytes]) -> list[FileMeta]:
        stage = f"data/stage-{uuid.uuid4().hex[:12]}"
        o = self.options
        rows = rows.withColumn("cut", found_at([c + b"\0" for c in cuts], F.col("user_key")) if cuts else F.lit(0))
        parts = rows.coalesce(1) if files == 1 else rows.repartitionByRange(files, "user_key") if files else rows.repartitionByRange("user_key")
        writer = parts.sortWithinPartitions("cut", "user_key", F.col("seq").desc()).withColumn("part", F.spark_partition_id()).write
        writer = writer.options(**{"parquet.block.size": str(o.row_group_size), "parquet.page.size": str(o.block_size), "compression": "uncompressed" if o.compression == "none" else o.compression})
        if o.bloom_bits_per_key:
            writer = writer.options(**{"parquet.bloom.filter.enabled#user_key": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.fpp#user_key": str(max(1e-9, 0.6185**o.bloom_bits_per_key))})
        writer.partitionBy("part", "cut").parquet(f"{self.files.base}/{stage}")
        whole = self.spark.read.schema("user_key binary, seq long, kind byte, value binary, expiry_ns long, part int, cut int").parquet(f"{self.files.base}/{stage}")
        of = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
        told = whole.groupBy("part", "cut").agg(F.min("user_key"), F.max("user_key"), F.min("seq"), F.max("seq"), F.count("*"), of(DELETE), of(MERGE), of(SET_TTL), F.sum(F.octet_length("user_key")), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).collect()  # a row a segment
        out: list[FileMeta] = []
        run = self.next_file
        for part, cut, low, high, *numbers in sorted(told):
            number, self.next_file = self.next_file, self.next_file + 1
            if not self.files.rename(f"{stage}/part={part}/cut={cut}", self._segment(number)):
                raise Corruption(f"{stage} can't become a segment")
            out.append(FileMeta(number, level, self.files.size(self._segment(number)), bytes(low), bytes(high), *numbers, run=run))
        self.files.delete(stage)
        return out

    def _pending(self) -> DataFrame:
        if self._shown is None:
            self._shown = self.spark.createDataFrame(self.memtable, ENTRY)
        return self._shown

    @_locked
    def flush(self) -> None:
        """Make the buffer a segment; nothing to do if it is empty."""
        self._usable()
        if self.memtable:
            self._flush(self._horizon())
            self._maybe_compact()

    def _flush(self, horizon: int) -> None:
        self._log(self.last_seq - len(self.unsynced) + 1)
        rows = flush_dedup(self._pending(), horizon)
        low, high = min(r[0] for r in self.memtable), max(r[0] for r in self.memtable)
        level = plan.flush_level(list(self.version.values()), low, high, self.options)
        size = sum(len(r[0]) + len(r[3] or b"") for r in self.memtable)
        added = self._write_segments(rows, level, max(1, size // self.options.target_file_size))
        logs = [int(n.split(".")[0]) for n in self.files.list("wal") if n.endswith(".json")]
        self._edit(added, log_number=max(logs, default=self.log_number))
        self.memtable, self.memtable_bytes, self._shown = [], 0, None
        self.counters["flushes"] += 1
        self.counters["flush_bytes"] += sum(f.size for f in added)
        self._delete_obsolete()

    # reads ----------------------------------------------------------------------------------------------------------

    def _horizon(self) -> int:
        return min((s.seq for s in self.snapshots), default=self.last_seq)

    def _table(self, files: list[FileMeta]) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(*[f"{self.files.base}/{self._segment(f.file_num)}" for f in files]) if files else self.spark.createDataFrame([], ENTRY)

    @_locked
    def entries(self, low: bytes | None = None, high: bytes | None = None, seq: int | None = None) -> DataFrame:
        """All stored entries; segments whose keys or sequence numbers can't matter are not read."""
        own = [f for f in self.version.values() if f.meets(low, None) and (high is None or f.smallest < high) and (seq is None or f.smallest_seq <= seq)]
        found = self._table(own)
        return found.unionByName(self._pending()) if self.memtable else found

    def _seq(self, snapshot: Snapshot | None) -> int:
        if snapshot is None:
            return self.last_seq
        if snapshot.store is not self or snapshot.released:
            raise ForeignSnapshot
        return snapshot.seq

    def _pin(self, holder: object) -> None:
        """Keep the present version's files while an object lives."""
        key = id(holder)
        self.pins[key] = frozenset(self.version)
        weakref.finalize(holder, self.pins.pop, key, None)

    @_locked
    def reader(self, snapshot: Snapshot | None = None, lower: bytes | None = None, upper: bytes | None = None) -> Reader:
        """A reader with its sequence number, clock and files fixed now; the files stay while it lives, and for
        ``retention_seconds`` after a later version drops them."""
        if self.closed:
            raise Closed
        seq = self._seq(snapshot)
        found = Reader(self.entries(lower, upper, seq), seq, self.now(), self.options.merger, lower=lower, upper=upper)
        self._pin(found)
        return found

    def get(self, key: bytes, snapshot: Snapshot | None = None) -> bytes:
        rows = self.reader(snapshot, key, key + b"\0").get(key).collect()
        if not rows:
            raise NotFound(key)
        return bytes(rows[0]["value"] or b"")

    def multi_get(self, keys: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        return self.reader(snapshot).multi_get(keys)

    def scan(self, lower: bytes | None = None, upper: bytes | None = None, reverse: bool = False, limit: int | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        return self.reader(snapshot, lower, upper).scan(reverse=reverse, limit=limit)

    @_locked
    def snapshot(self) -> Snapshot:
        self._usable()
        s = Snapshot(self, self.last_seq)
        self.snapshots.add(s)
        return s

    # maintenance ----------------------------------------------------------------------------------------------------

    def _maybe_compact(self) -> None:
        if not self.options.disable_automatic_compactions:
            while self.compact():
                pass

    @_locked
    def compact(self) -> bool:
        """One compaction if the strategy finds one."""
        self._usable()
        files = list(self.version.values())
        p = plan.pick_leveled(files, self.options, self.pointers) if self.options.strategy == "leveled" else plan.pick_tiered(files, self.options)
        if p is None or not p.inputs:
            return False
        self._run(p)
        return True

    def _run(self, p: plan.Plan) -> None:
        if p.move:
            f = p.inputs[0]
            self._edit([FileMeta(**asdict(f) | {"level": p.level})], [f.file_num], p.pointers)
            self.dropped.pop(f.file_num, None)
            self.counters["moves"] += 1
            return
        ranges = plan.covered_ranges(list(self.version.values()), p.inputs, p.level)
        while len(ranges) > MAX_RANGES:  # a gap taken for covered only keeps deletions for longer
            ranges = [(a[0], max(a[1], b[1])) for a, b in zip(ranges[::2], [*ranges[1::2], ranges[-1]], strict=False)]
        base = True
        if ranges:
            at = found_at([low for low, _ in ranges], F.col("user_key"))
            base = F.coalesce(F.get(F.lit([high for _, high in ranges]), at - 1) < F.col("user_key"), F.lit(True))
        low, high = plan.span(p.inputs)
        size = sum(f.size for f in p.inputs)
        cuts = plan.output_cuts(list(self.version.values()), p.level, low, high, self.options)
        remove = None
        if self.options.compaction_filter is not None:
            remove = lambda key, value: self.options.compaction_filter(p.level, key, value)
        kept = functools.partial(retain, self._table(p.inputs), self._horizon(), self.now(), base, remove=remove, snapshots=bool(self.snapshots))
        files = min(200_000, max(1, -(-size // self.options.target_file_size)))
        try:
            added = self._staged(kept(merger=self.options.merger), p.level, files, cuts)
        except Exception as e:
            if self.options.merger is None or not any(f.merges for f in p.inputs):
                self.error = e
                raise
            # A merger that fails leaves its operands, for reads to report; all else is done without it.
            added = self._write_segments(kept(merger=None), p.level, files, cuts)
            self.counters["kept_operands"] += 1
        self._edit(added, [f.file_num for f in p.inputs], p.pointers)
        self.counters["compactions"] += 1
        self.counters["compaction_bytes"] += sum(f.size for f in added)
        self._delete_obsolete()

    @_locked
    def compact_range(self, low: bytes | None = None, high: bytes | None = None) -> None:
        """Compact all keys in a range whose bounds are both inclusive."""
        self.flush()
        for start, end in plan.pick_manual(list(self.version.values()), low, high):
            files = list(self.version.values())
            inputs = plan.overlapping(files, start, low, high)
            if not inputs:
                continue
            if start != end:
                inputs += plan.overlapping(files, end, *plan.span(inputs))
            self._run(plan.Plan(inputs, end))

    @_locked
    def _delete_obsolete(self) -> None:
        """Files that no version, reader or retention keeps; nothing after an error, and no names that aren't the store's."""
        if self.error:
            return
        pinned = frozenset().union(*list(self.pins.values()))
        late = time.time() - self.options.retention_seconds
        try:
            for name in self.files.list("data"):
                number = int(name) if name.isdigit() else None
                if name.startswith("stage-") or (number is not None and number not in self.version and number not in pinned and self.dropped.get(number, 0) <= late):
                    self.files.delete(f"data/{name}")
                    self.dropped.pop(number, None)
            for name in self.files.list("wal"):
                if name.endswith(".json") and int(name.split(".")[0]) <= self.log_number:
                    self.files.delete(f"wal/{name}")
        except Exception as e:
            self.error = e
            raise

    @_locked
    def checkpoint(self, path: str) -> None:
        """A copy that opens on its own; the target must be empty."""
        self.flush()
        to = Files(self.spark, path)
        if to.list(""):
            raise Exists(path)
        for f in self.version.values():
            self.files.copy(self._segment(f.file_num), to)
        to.create("manifest/00000001.json", _sealed(self._record(added=[_packed(f) for f in self.version.values()], pointers={})))

    # what it tells --------------------------------------------------------------------------------------------------

    @_locked
    def file_table(self) -> DataFrame:
        """A row a segment, with its properties."""
        rows = [(f.file_num, f.level, f.size, f.smallest, f.largest, f.smallest_seq, f.largest_seq, f.entries, f.deletions, f.merges, f.expiring, f.key_bytes, f.value_bytes, self.options.comparer.name, self.options.compression, self.options.bloom_bits_per_key) for f in self.version.values()]
        return self.spark.createDataFrame(rows, "file_num long, level int, size long, smallest_key binary, largest_key binary, smallest_seq long, largest_seq long, n_entries long, n_deletions long, n_merges long, n_expiring long, key_bytes long, value_bytes long, comparer string, compression string, bloom_bits int")

    @_locked
    def dump(self) -> DataFrame:
        """Every stored entry in order, with its segment (-1: the buffer) and level."""
        stored = self._table(list(self.version.values())).withColumn("file_num", F.regexp_extract(F.col("_metadata.file_path"), r"data/(\d+)/", 1).cast("long"))
        every = stored.unionByName(self._pending().withColumn("file_num", F.lit(-1).cast("long"))) if self.memtable else stored
        of = self.file_table().select("file_num", "level")  # a row a segment
        return every.join(F.broadcast(of), "file_num", "left").orderBy("user_key", F.col("seq").desc())

    @_locked
    def dump_manifest(self) -> DataFrame:
        """A row a stored manifest record: its number, whether it is whole, and its body."""
        rows = [(int(n.split(".")[0]), n.endswith(".whole"), json.dumps(_unsealed(self.files.read(f"manifest/{n}")))) for n in self.files.list("manifest")]
        return self.spark.createDataFrame(rows, "number long, whole boolean, body string")

    @_locked
    def check(self) -> None:
        """Raise Corruption if files of a level from 1 on overlap, or a key is newer in a lower run than in one above."""
        if not self.version:
            return
        if levels.order_violations(self.file_table()).limit(1).count():
            raise Corruption("files overlap")
        rank = {f.file_num: k for k, r in enumerate(plan.runs_of(list(self.version.values()), self.options.num_levels)) for f in r}
        runs = self.spark.createDataFrame(list(rank.items()), "file_num long, run int")
        if levels.sequence_violations(self.dump().where("file_num >= 0").join(F.broadcast(runs), "file_num")).limit(1).count():
            raise Corruption("sequence numbers of runs are out of order")

    @_locked
    def verify(self) -> None:
        """Read every segment and raise Corruption where it isn't what the manifest says."""
        if not self.version:
            return
        kinds = [F.count(F.when(F.col("kind") == k, 1)) for k in (DELETE, MERGE, SET_TTL)]
        told = self.dump().where("file_num >= 0").groupBy("file_num").agg(F.min("user_key"), F.max("user_key"), F.min("seq"), F.max("seq"), F.count("*"), *kinds).collect()  # a row a segment
        found = {r[0]: (bytes(r[1]), bytes(r[2]), *r[3:]) for r in told}
        for f in self.version.values():
            if found.get(f.file_num) != (f.smallest, f.largest, f.smallest_seq, f.largest_seq, f.entries, f.deletions, f.merges, f.expiring):
                raise Corruption(f"segment {f.file_num} isn't what the manifest says")

    @_locked
    def metrics(self) -> dict:
        files = list(self.version.values())
        written = self.counters["flush_bytes"] + self.counters["compaction_bytes"]
        per = {lv: {"files": sum(f.level == lv for f in files), "size": sum(f.size for f in files if f.level == lv)} for lv in range(self.options.num_levels)}
        return self.counters | {
            "levels": per,
            "disk_size": sum(f.size for f in files),
            "sorted_runs": len(plan.runs_of(files, self.options.num_levels)),
            "write_amplification": written / self.counters["user_bytes"] if self.counters["user_bytes"] else 0.0,
            "snapshots": len(self.snapshots),
            "readers": len(self.pins),
            "obsolete_files": len(self.dropped),
            "memtable_entries": len(self.memtable),
            "memtable_bytes": self.memtable_bytes,
            "manifest_edits": self.edit_number - self.folded_at,
            "last_seq": self.last_seq,
        }

    def metrics_text(self) -> str:
        """The metrics as a small table."""
        m = self.metrics()
        lines = [f"L{lv}  files {x['files']:>5}  size {format_bytes(x['size']):>10}" for lv, x in m["levels"].items() if x["files"]]
        return "\n".join([*lines, f"flushes {m['flushes']}  compactions {m['compactions']}  stalls {m['stalls']}  write amplification {m['write_amplification']:.2f}"])

    @_locked
    def close(self) -> None:
        """Give up the lease, after logging what isn't yet. The buffer stays in the log and is read again on opening."""
        if self.closed:
            return
        try:
            if not self.error:
                self._log(self.last_seq - len(self.unsynced) + 1)
        finally:
            self.closed = True
            self.lease.release()


def format_bytes(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TiB"
