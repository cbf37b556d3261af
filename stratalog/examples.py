"""Queries that run a store: their rows are what the store gives back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.keys import decode_decimal, encode_decimal
from stratalog.functions.mergers import SumMerger
from stratalog.model import Options
from stratalog.operators.scan import Reader
from stratalog.sources.batch import Batch
from stratalog.sources.logs import events_log
from stratalog.sources.store import Store
from stratalog.streaming.ingest import ingest

NOW = 1_706_054_400_000_000_000
LOWER, UPPER = "u000020", "u000060"


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share; a local one only where the master is local and none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stratalog-")
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex[:12]}"


def _options(**more) -> Options:
    return Options(merger=SumMerger(decode_decimal, encode_decimal), clock=lambda: NOW, **more)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_key").cast("string").alias("user_key"), F.col("value").cast("string").cast("long").alias("value"))


def _binary(log: DataFrame) -> DataFrame:
    return log.select(F.col("user_key").cast("binary").alias("user_key"), "seq", F.col("kind").cast("byte").alias("kind"), F.col("value").cast("string").cast("binary").alias("value"), "expiry_ns")


def _kept(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows as a table of their own, as the store they come from is closed."""
    return spark.createDataFrame(rows.collect(), rows.schema)


def _nations(spark: SparkSession, sf_dir: str) -> list:
    """The 25 nations, as keys and numbers."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()
    return [(r[0], b"n%03d" % r[0], r[1]) for r in rows]


def _ops(log: DataFrame) -> DataFrame:
    return _binary(log).withColumn("op_index", F.col("seq"))


def store_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole event log written in bulk and compacted; a full scan."""
    with Store(spark, _folder(spark), _options(disable_automatic_compactions=True)) as store:
        store.write_frame(_ops(events_log(spark, sf_dir)))
        store.compact_range()
        return _shown(store.scan())


def compact_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manual compaction of a key range, whose bounds are both inclusive: what is then stored of it."""
    with Store(spark, _folder(spark), _options(disable_automatic_compactions=True)) as store:
        store.write_frame(_ops(events_log(spark, sf_dir)))
        store.compact_range(LOWER.encode(), UPPER.encode())
        kept = store.dump().where(F.col("user_key").between(F.lit(LOWER.encode()), F.lit(UPPER.encode())))
        return kept.select(F.col("user_key").cast("string").alias("user_key"), "seq", F.col("kind").cast("int").alias("kind"), F.col("value").cast("string").cast("long").alias("value"), "expiry_ns")


def reader_during_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader of the first two fifths of the log, run after all was written and compacted twice."""
    log = events_log(spark, sf_dir)
    cut = log.agg(F.max("seq")).first()[0] * 2 // 5
    with Store(spark, _folder(spark), _options(disable_automatic_compactions=True)) as store:
        store.write_frame(_ops(log.where(F.col("seq") <= cut)))
        reader = store.reader()
        store.write_frame(_ops(log.where(F.col("seq") > cut)))
        store.compact_range()
        store.compact_range()
        return _shown(reader.scan())


def batch_last_op_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sets of the log as one atomic commit: of a key's operations the last stands."""
    with Store(spark, _folder(spark), _options(disable_automatic_compactions=True)) as store:
        store.write_frame(_ops(events_log(spark, sf_dir).where("kind = 1")))
        return _shown(store.scan())


def batch_of_every_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch with operations of every kind on the keys of the nations; later ones win over earlier ones."""
    batch = Batch()
    for n, key, region in _nations(spark, sf_dir):
        batch.put(key, b"%d" % region)
        if n % 4 == 0:
            batch.merge(key, b"10")
        elif n % 4 == 2:
            batch.delete(key).put(key, b"7")
        elif n % 4 == 3:
            batch.put_with_expiry(key, b"1", NOW)
    with Store(spark, _folder(spark), _options()) as store:
        store.write(batch)
        return _kept(spark, _shown(store.scan()))


def wal_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of a process that never flushed are there after opening again."""
    path = _folder(spark)
    store = Store(spark, path, _options())
    for _, key, region in _nations(spark, sf_dir):
        store.put(key, b"%d" % region)
    store.merge(b"n003", b"100")
    store.delete(b"n004")
    del store  # as after a crash: never closed
    with Store(spark, path, _options()) as again:
        return _kept(spark, _shown(again.scan()))


def checkpoint_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy opened by itself; later writes to the original don't show."""
    path, copy = _folder(spark), _folder(spark)
    with Store(spark, path, _options()) as store:
        for _, key, region in _nations(spark, sf_dir):
            store.put(key, b"%d" % region, sync=False)
        store.checkpoint(copy)
        store.put(b"n999", b"999")
    with Store(spark, copy, _options()) as store:
        return _kept(spark, _shown(store.scan()))


def _streamed(spark: SparkSession, sf_dir: str, store: Store, times: int) -> None:
    source = _folder(spark)
    _binary(events_log(spark, sf_dir)).write.parquet(source)
    stream = spark.readStream.schema("user_key binary, seq long, kind byte, value binary, expiry_ns long").parquet(source)
    for k in range(times):
        ingest(stream, store, f"{source}-progress{k}", name="events").awaitTermination()


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream, one commit a micro-batch."""
    with Store(spark, _folder(spark), _options(disable_automatic_compactions=True)) as store:
        _streamed(spark, sf_dir, store, 1)
        return _shown(store.scan())


def stream_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same micro-batch twice, as after a crash that lost the stream's progress: it is written once."""
    with Store(spark, _folder(spark), _options(disable_automatic_compactions=True)) as store:
        _streamed(spark, sf_dir, store, 2)
        return _shown(store.scan())


def cursor_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cursor over the event log: some steps ahead, some back, a seek."""
    cursor = Reader(events_log(spark, sf_dir), None, NOW, SumMerger()).cursor(page=16)
    seen = []
    cursor.first()
    for step in ("next",) * 5 + ("prev",) * 2:
        getattr(cursor, step)()
        seen.append((len(seen), cursor.key(), cursor.value()))
    if cursor.seek_ge("u000100"):
        seen.append((len(seen), cursor.key(), cursor.value()))
    return spark.createDataFrame(seen, "step int, user_key string, value long")


EXAMPLES = [store_tour, compact_range, reader_during_compaction, batch_last_op_wins, batch_of_every_kind, wal_recover, checkpoint_open, stream_ingest, stream_retry, cursor_walk]
