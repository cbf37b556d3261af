"""The library's queries by name over the tables of a folder, and the same in DuckDB's SQL where it can say it.

Reads are of the whole log; where a snapshot is the point, it lies at a part of the log's largest sequence number.
Times are fixed so that both sides see the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog import examples
from stratalog.functions import key_filter
from stratalog.functions.keys import prefix_bounds
from stratalog.functions.mergers import AppendMerger, LastMerger, MaxMerger, MinMerger, SumMerger, UdfMerger
from stratalog.operators import levels, retention
from stratalog.operators.resolve import difference, expired, history, resolve, tombstoned
from stratalog.operators.scan import Reader
from stratalog.plans.compaction import FileMeta, runs_of
from stratalog.sources.logs import EVENTS_SQL, ORDERS_SQL, events_log, orders_log

#: A snapshot within the log and an older one, in fifths of its largest sequence number, as SQL says them.
S, OLD = ("(SELECT (max(event_id) + 1) * 4 // 5 FROM events)", "(SELECT (max(event_id) + 1) * 2 // 5 FROM events)")
#: 2024-01-24 00:00:00 UTC.
NOW = 1_706_054_400_000_000_000
#: A clock 30 days later, when entries with a time to live are over.
LATE = NOW + 30 * 86_400 * 10**9
KEY, LOWER, UPPER = "u000042", "u000020", "u000060"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _resolved(seq: int | str | None, now: int = NOW, ops: str = "CAST(sum(value) FILTER (kind = 3) AS BIGINT)", full: str = "coalesce(CASE WHEN live THEN bv END, 0) + coalesce(ops, 0)", log: str = "ev", more: str = "") -> str:
    """The CTEs up to ``res`` (user_key, value): what resolve() gives."""
    source = EVENTS_SQL if log == "ev" else ORDERS_SQL
    where = f"WHERE {' AND '.join(x for x in (f'seq <= {seq}' if seq is not None else '', more) if x)}" if seq is not None or more else ""
    return f"""WITH {source},
vis AS (SELECT *, max(CASE WHEN kind <> 3 THEN seq END) OVER (PARTITION BY user_key) AS bs FROM {log} {where}),
fold AS (
  SELECT user_key, max(CASE WHEN seq = bs THEN kind END) AS bk, max(CASE WHEN seq = bs THEN value END) AS bv, max(CASE WHEN seq = bs THEN expiry_ns END) AS be,
    count(*) FILTER (kind = 3) AS n_ops, {ops} AS ops
  FROM vis WHERE seq >= coalesce(bs, 0) GROUP BY user_key),
lv AS (SELECT *, coalesce(bk = 1 OR (bk = 4 AND {now} < be), false) AS live FROM fold),
res AS (SELECT user_key, CASE WHEN n_ops > 0 THEN {full} ELSE bv END AS value FROM lv WHERE n_ops > 0 OR live)
"""


def _fifths(spark: SparkSession, sf_dir: str, n: int) -> int:
    """The sequence number at n fifths of the event log."""
    return (spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] + 1) * n // 5


def _reader(spark: SparkSession, sf_dir: str, seq: int | None = None, **more) -> Reader:
    return Reader(events_log(spark, sf_dir), seq, NOW, SumMerger(), **more)


_NEWEST = f"WITH {EVENTS_SQL}, nw AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) = 1)\n"
_COLUMNS = "SELECT user_key, value FROM res"


# --- reads ----------------------------------------------------------------------------------------------------------


@_query(_resolved(None) + f"{_COLUMNS} WHERE user_key = '{KEY}'")
def get_latest(spark, sf_dir):
    return _reader(spark, sf_dir).get(KEY)


@_query(_resolved(OLD) + f"{_COLUMNS} WHERE user_key = '{KEY}'")
def get_as_of_seq(spark, sf_dir):
    return _reader(spark, sf_dir, _fifths(spark, sf_dir, 2)).get(KEY)


@_query(_resolved(None) + f"{_COLUMNS} WHERE user_key = 'nobody'")
def get_missing(spark, sf_dir):
    return _reader(spark, sf_dir).get("nobody")


@_query(_resolved(None) + f"{_COLUMNS} WHERE user_key IN (SELECT 'u' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') FROM customer WHERE c_nationkey < 5)")
def multi_get(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_nationkey < 5").select(F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("user_key"))
    return _reader(spark, sf_dir).multi_get(keys)


@_query(_resolved(None) + _COLUMNS)
def scan_full(spark, sf_dir):
    return _reader(spark, sf_dir).scan()


@_query(_resolved(None) + f"{_COLUMNS} WHERE user_key >= '{LOWER}' AND user_key < '{UPPER}'")
def scan_bounded(spark, sf_dir):
    return _reader(spark, sf_dir).scan(LOWER, UPPER)


@_query(_resolved(None) + f"{_COLUMNS} WHERE user_key < ''")
def scan_empty_upper(spark, sf_dir):
    return _reader(spark, sf_dir).scan(upper="")


@_query(_resolved(None) + f"{_COLUMNS} WHERE starts_with(user_key, 'u0001')")
def scan_prefix(spark, sf_dir):
    lower, upper = prefix_bounds(b"u0001")
    return _reader(spark, sf_dir).scan(lower.decode(), upper.decode())


@_query(_resolved(None) + "SELECT user_key, value, row_number() OVER (ORDER BY user_key DESC) AS place FROM res ORDER BY user_key DESC LIMIT 20")
def scan_reverse(spark, sf_dir):
    from pyspark.sql import Window

    return _reader(spark, sf_dir).scan(reverse=True, limit=20).withColumn("place", F.row_number().over(Window.orderBy(F.col("user_key").desc())).cast("long"))


@_query(_resolved(None) + f"{_COLUMNS} ORDER BY user_key LIMIT 10")
def scan_limit(spark, sf_dir):
    return _reader(spark, sf_dir).scan(limit=10)


@_query(_resolved(None) + "SELECT user_key FROM res")
def keys_only(spark, sf_dir):
    return _reader(spark, sf_dir).scan(values=False)


@_query(_resolved(None) + f"{_COLUMNS} ORDER BY user_key LIMIT 1")
def first_key(spark, sf_dir):
    return _reader(spark, sf_dir).first()


@_query(_resolved(None) + f"{_COLUMNS} ORDER BY user_key DESC LIMIT 1")
def last_key(spark, sf_dir):
    return _reader(spark, sf_dir).last()


@_query(_resolved(None) + f"{_COLUMNS} WHERE user_key >= '{KEY}x' ORDER BY user_key LIMIT 1")
def seek_ge(spark, sf_dir):
    return _reader(spark, sf_dir).seek_ge(f"{KEY}x")


@_query(_resolved(None) + f"{_COLUMNS} WHERE user_key < '{KEY}' ORDER BY user_key DESC LIMIT 1")
def seek_lt(spark, sf_dir):
    return _reader(spark, sf_dir).seek_lt(KEY)


@_query(_resolved(None) + f"{_COLUMNS} WHERE user_key >= '{LOWER}' AND user_key < '{UPPER}' ORDER BY user_key LIMIT 1")
def seek_clamped(spark, sf_dir):
    return _reader(spark, sf_dir, lower=LOWER, upper=UPPER).seek_ge("a")


@_query(_resolved(None) + f"{_COLUMNS} WHERE user_key > '{KEY}' ORDER BY user_key LIMIT 1")
def next_key(spark, sf_dir):
    return _reader(spark, sf_dir).next_after(KEY)


@_query(_resolved(None) + f"{_COLUMNS} WHERE user_key < '{UPPER}' ORDER BY user_key DESC LIMIT 1")
def prev_key(spark, sf_dir):
    return _reader(spark, sf_dir).seek_lt(UPPER)


@_query(_resolved(OLD) + f", b AS ({_resolved(S)} {_COLUMNS}) SELECT coalesce(res.user_key, b.user_key) AS user_key, res.value AS old_value, b.value AS new_value FROM res FULL JOIN b ON res.user_key = b.user_key WHERE res.value IS DISTINCT FROM b.value")
def snapshot_diff(spark, sf_dir):
    return difference(events_log(spark, sf_dir), _fifths(spark, sf_dir, 2), _fifths(spark, sf_dir, 4), NOW, SumMerger())


@_query(_NEWEST + "SELECT user_key, seq FROM nw WHERE kind = 0")
def tombstoned_keys(spark, sf_dir):
    return tombstoned(events_log(spark, sf_dir))


@_query(f"WITH {EVENTS_SQL} SELECT seq, CAST(kind AS INTEGER) AS kind, value, expiry_ns FROM ev WHERE user_key = '{KEY}'")
def key_history(spark, sf_dir):
    return history(events_log(spark, sf_dir), KEY).select("seq", "kind", "value", "expiry_ns")


_NO_OPS = f"WITH {EVENTS_SQL}, nw AS (SELECT * FROM ev WHERE kind <> 3 QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) = 1)\n"


@_query(_NO_OPS + f"SELECT user_key, value FROM nw WHERE kind = 1 OR (kind = 4 AND expiry_ns > {NOW})")
def latest_without_merges(spark, sf_dir):
    return resolve(events_log(spark, sf_dir).where("kind <> 3"), None, NOW, merges=False)


@_query(_NEWEST + f"SELECT user_key, value FROM nw WHERE kind = 4 AND expiry_ns > {NOW}")
def ttl_live(spark, sf_dir):
    log = events_log(spark, sf_dir)
    newest = log.groupBy("user_key").agg(F.max_by(F.struct("kind", "value", "expiry_ns"), "seq").alias("b"))
    return newest.where((F.col("b.kind") == 4) & (F.col("b.expiry_ns") > NOW)).select("user_key", F.col("b.value").alias("value"))


@_query(_NEWEST + f"SELECT user_key, expiry_ns FROM nw WHERE kind = 4 AND expiry_ns <= {LATE}")
def ttl_expired(spark, sf_dir):
    return expired(events_log(spark, sf_dir), None, LATE)


#: The expiry of one entry as the clock: it is over at that very time.
_BOUNDARY = "(SELECT max(expiry_ns) FROM ev)"


@_query(f"WITH {EVENTS_SQL}, last AS (SELECT * FROM ev WHERE expiry_ns = {_BOUNDARY}) SELECT d AS shift, CAST(count(*) FILTER ({_BOUNDARY} + d < expiry_ns) AS BIGINT) AS live FROM last, (VALUES (-1), (0), (1)) t(d) GROUP BY d")
def ttl_boundary(spark, sf_dir):
    log = events_log(spark, sf_dir)
    top = log.agg(F.max("expiry_ns").alias("now"))
    last = log.join(F.broadcast(top), F.col("expiry_ns") == F.col("now"))
    shifts = last.withColumn("shift", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    return shifts.groupBy("shift").agg(F.count(F.when(F.col("now") + F.col("shift") < F.col("expiry_ns"), 1)).alias("live"))


# --- mergers --------------------------------------------------------------------------------------------------------


@_query(_resolved(None, log="od") + _COLUMNS)
def merge_sum(spark, sf_dir):
    return resolve(orders_log(spark, sf_dir), None, NOW, SumMerger())


@_query(_resolved(None, log="od") + _COLUMNS)
def merge_sum_skewed(spark, sf_dir):
    return resolve(orders_log(spark, sf_dir), None, NOW, SumMerger(), skewed=True)


@_query(_resolved(None, ops="max(value) FILTER (kind = 3)", full="greatest(CASE WHEN live THEN bv END, ops)") + _COLUMNS)
def merge_max(spark, sf_dir):
    return resolve(events_log(spark, sf_dir), None, NOW, MaxMerger())


@_query(_resolved(None, ops="min(value) FILTER (kind = 3)", full="least(CASE WHEN live THEN bv END, ops)") + _COLUMNS)
def merge_min(spark, sf_dir):
    return resolve(events_log(spark, sf_dir), None, NOW, MinMerger())


@_query(_resolved(None, ops="arg_max(value, seq) FILTER (kind = 3)", full="ops") + _COLUMNS)
def merge_last(spark, sf_dir):
    return resolve(events_log(spark, sf_dir), None, NOW, LastMerger())


@_query(_resolved(None, ops="string_agg(CAST(value AS VARCHAR), ',' ORDER BY seq) FILTER (kind = 3)", full="concat_ws(',', CASE WHEN live THEN CAST(bv AS VARCHAR) END, ops)").replace("ELSE bv END AS value", "ELSE CAST(bv AS VARCHAR) END AS value") + _COLUMNS)
def merge_append_ordered(spark, sf_dir):
    return resolve(events_log(spark, sf_dir), None, NOW, AppendMerger())


def _over(bases: str) -> str:
    return _resolved(None).rstrip() + f" SELECT user_key, CAST(ops AS BIGINT) AS value FROM lv WHERE n_ops > 0 AND {bases}"


def _merged_over(spark, sf_dir, keep, now: int = NOW) -> DataFrame:
    """Resolved rows of the keys whose newest base meets a condition and that have operands above it."""
    log = events_log(spark, sf_dir)
    by_key = log.groupBy("user_key").agg(F.max_by(F.struct("seq", "kind", "expiry_ns"), F.when(F.col("kind") != 3, F.col("seq"))).alias("b"), F.max(F.when(F.col("kind") == 3, F.col("seq"))).alias("op"))
    keys = by_key.where(F.col("op") > F.coalesce("b.seq", F.lit(0))).where(keep).select("user_key")
    return Reader(log, None, now, SumMerger()).multi_get(keys)


@_query(_over("bk = 0"))
def merge_over_delete(spark, sf_dir):
    return _merged_over(spark, sf_dir, F.col("b.kind") == 0)


@_query(_over(f"bk = 4 AND be <= {LATE}"))
def merge_over_expired_ttl(spark, sf_dir):
    return _merged_over(spark, sf_dir, (F.col("b.kind") == 4) & (F.col("b.expiry_ns") <= LATE), LATE)


@_query(_resolved(None, log="od").rstrip() + " SELECT user_key, CAST(ops AS BIGINT) AS value FROM lv WHERE n_ops > 0 AND bk IS NULL")
def merge_without_base(spark, sf_dir):
    """Customers that only have operands."""
    log = orders_log(spark, sf_dir)
    no_base = log.groupBy("user_key").agg(F.min("kind").alias("a"), F.max("kind").alias("b")).where("a = 3 and b = 3")
    return Reader(log, None, NOW, SumMerger()).multi_get(no_base)


@_query(_resolved(None, ops="list(value ORDER BY seq) FILTER (kind = 3)", full="CAST(coalesce(CASE WHEN live THEN bv END, 0) + list_sum(ops[-3:]) AS BIGINT)") + _COLUMNS)
def udf_merger(spark, sf_dir):
    """Any function as a merger: the value and the last three operands."""

    def newest_three(key, existing, exists, operands):
        return (existing or 0) + sum(operands[-3:])

    return resolve(events_log(spark, sf_dir), None, NOW, UdfMerger(newest_three, "long"))


@_query(f"WITH {EVENTS_SQL} SELECT DISTINCT user_key FROM ev JOIN customer ON user_key = 'u' || lpad(CAST(c_custkey AS VARCHAR), 6, '0')")
def key_filter_semi_join(spark, sf_dir):
    """Customers with events: the filter of the events' keys thins them out, an exact semi-join does the rest."""
    events = events_log(spark, sf_dir).select("user_key").distinct()
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("user_key"))
    bits, probes = key_filter.shape(keys.count())
    near = key_filter.may_contain(keys, "user_key", key_filter.build(events, "user_key", bits, probes), bits, probes)
    return near.join(events, "user_key", "left_semi").distinct()


# --- retention ------------------------------------------------------------------------------------------------------

_ENTRIES = "user_key, seq, CAST(kind AS INTEGER) AS kind, value, expiry_ns"


def _dedup(h: int | str) -> str:
    return f"WITH {EVENTS_SQL}, m AS (SELECT *, max(CASE WHEN seq <= {h} AND kind <> 3 THEN seq END) OVER (PARTITION BY user_key) AS bs FROM ev) SELECT {_ENTRIES} FROM m WHERE seq > {h} OR seq >= coalesce(bs, 0)"


@_query(_dedup(1 << 56))
def flush_dedup(spark, sf_dir):
    return retention.flush_dedup(events_log(spark, sf_dir), 1 << 56)


@_query(_dedup(OLD))
def flush_dedup_snapshot(spark, sf_dir):
    return retention.flush_dedup(events_log(spark, sf_dir), _fifths(spark, sf_dir, 2))


def _retained(h: int | str, base: bool, removed: str = "false", more: str = "", fold: bool = True) -> str:
    """The entries that retain() leaves, as one statement."""
    b = "true" if base else "false"
    f = f"(top > coalesce(bs, 0) AND CASE WHEN bs IS NULL THEN {b} ELSE bk <> 4 END)" if fold else "false"
    return f"""WITH {EVENTS_SQL},
m0 AS (SELECT *, max(CASE WHEN seq <= {h} THEN seq END) OVER (PARTITION BY user_key) AS top, max(CASE WHEN seq <= {h} AND kind <> 3 THEN seq END) OVER (PARTITION BY user_key) AS bs,
  max(seq) OVER (PARTITION BY user_key) AS nw FROM ev {more}),
m1 AS (SELECT *, max(CASE WHEN seq = bs THEN kind END) OVER (PARTITION BY user_key) AS bk FROM m0),
m2 AS (SELECT *, coalesce({f}, false) AND seq <= {h} AS fold, seq <= {h} AND NOT coalesce(top > coalesce(bs, 0), false) AS decides FROM m1 WHERE seq > {h} OR seq >= coalesce(bs, 0)),
m3 AS (SELECT *, decides AND (kind = 0 OR (kind = 4 AND expiry_ns <= {NOW}) OR (kind IN (1, 4) AND seq = nw AND ({removed}))) AS gone FROM m2 WHERE NOT fold)
SELECT user_key, seq, CAST(CASE WHEN gone THEN 0 ELSE kind END AS INTEGER) AS kind, CASE WHEN NOT gone THEN value END AS value, CASE WHEN NOT gone THEN expiry_ns END AS expiry_ns
FROM m3 WHERE NOT (gone AND {b}) AND NOT (kind = 0 AND seq <= {h} AND {b})
UNION ALL
SELECT user_key, max(seq), 1, CAST(coalesce(max(CASE WHEN kind = 1 THEN value END), 0) + coalesce(sum(value) FILTER (kind = 3), 0) AS BIGINT), NULL FROM m2 WHERE fold GROUP BY user_key"""


def _kept(spark, sf_dir, h: int, base: bool, log: DataFrame | None = None, **more) -> DataFrame:
    return retention.retain(events_log(spark, sf_dir) if log is None else log, h, NOW, base, **({"merger": SumMerger()} | more))


@_query(_retained(1 << 56, True))
def compact_full(spark, sf_dir):
    return _kept(spark, sf_dir, 1 << 56, True)


@_query(_retained(S, False))
def compact_keep_tombstones(spark, sf_dir):
    return _kept(spark, sf_dir, _fifths(spark, sf_dir, 4), False)


@_query(_retained(1 << 56, True, removed="value < 5000"))
def compact_filter(spark, sf_dir):
    return _kept(spark, sf_dir, 1 << 56, True, remove=lambda k, v: v < 5000)


@_query(f"SELECT * FROM ({_retained(S, True)}) WHERE kind = 1 AND seq <= {S}")
def fold_merge(spark, sf_dir):
    h = _fifths(spark, sf_dir, 4)
    return _kept(spark, sf_dir, h, True).where((F.col("kind") == 1) & (F.col("seq") <= h))


# --- files and levels -----------------------------------------------------------------------------------------------

_FILES = f"""WITH {EVENTS_SQL}, {ORDERS_SQL},
dealt AS (
  SELECT user_key, seq, 1000 + (seq - 1) // 500 AS file_num, 0 AS level FROM ev
  UNION ALL SELECT user_key, seq, CAST(substr(user_key, 2) AS BIGINT) // 100, 1 FROM od),
files AS (SELECT CAST(file_num AS BIGINT) AS file_num, level, min(user_key) AS smallest_key, max(user_key) AS largest_key, min(seq) AS smallest_seq, max(seq) AS largest_seq, count(*) AS n_entries FROM dealt GROUP BY 1, 2)
"""


def files(spark, sf_dir) -> DataFrame:
    """Files as both engines can see them: level 0 by sequence from the events, level 1 by key from the orders."""
    ev = levels.file_metadata(events_log(spark, sf_dir), F.floor((F.col("seq") - 1) / 500) + 1000, 0)
    od = levels.file_metadata(orders_log(spark, sf_dir), F.floor(F.substring("user_key", 2, 8).cast("long") / 100), 1)
    return ev.unionByName(od)


@_query(_FILES + "SELECT * FROM files")
def file_metadata(spark, sf_dir):
    return files(spark, sf_dir)


@_query(_FILES + "SELECT a.file_num AS file_a, b.file_num AS file_b FROM files a JOIN files b ON a.level = b.level AND a.file_num < b.file_num AND a.smallest_key <= b.largest_key AND b.smallest_key <= a.largest_key")
def overlap_files(spark, sf_dir):
    return levels.overlaps(files(spark, sf_dir))


@_query(_FILES + ", below AS (SELECT * FROM files WHERE level = 1 AND file_num % 2 = 0) SELECT DISTINCT user_key, NOT EXISTS (SELECT 1 FROM below b WHERE od.user_key BETWEEN b.smallest_key AND b.largest_key) AS is_base FROM od")
def base_level_keys(spark, sf_dir):
    """Customers whose key no file of the lower level covers, if every other file of level 1 lies there."""
    below = files(spark, sf_dir).where("level = 1 and file_num % 2 = 0")
    return retention.base_keys(orders_log(spark, sf_dir), below)


@_query(_FILES + "SELECT file_num FROM files WHERE NOT (file_num % 3 = 0)")
def obsolete_files(spark, sf_dir):
    listing = files(spark, sf_dir).select("file_num")
    return levels.obsolete(listing, listing.where("file_num % 3 = 0"))


@_query(_FILES + "SELECT file_num FROM files WHERE level = 1 UNION SELECT file_num FROM files WHERE file_num % 2 = 0")
def live_files(spark, sf_dir):
    every = files(spark, sf_dir)
    return levels.live_files([every.where("level = 1").select("file_num"), every.where("file_num % 2 = 0").select("file_num")])


@_query(_FILES + "SELECT file_num, level FROM files WHERE level = 0 AND file_num > 1002 UNION ALL SELECT 9999, 1")
def version_edit(spark, sf_dir):
    version = files(spark, sf_dir).where("level = 0").select("file_num", "level")
    return levels.apply_edit(version, version.where("file_num <= 1002"), spark.createDataFrame([(9999, 1)], "file_num long, level int"))


@_query(_FILES + "SELECT level, count(*) AS n_files, CAST(sum(n_entries) AS BIGINT) AS size, min(smallest_seq) AS smallest_seq, max(largest_seq) AS largest_seq FROM files GROUP BY level")
def level_metrics(spark, sf_dir):
    return levels.level_metrics(files(spark, sf_dir))


@_query(_FILES + "SELECT count(*) FILTER (level = 0) + count(DISTINCT level) FILTER (level > 0) AS sorted_runs FROM files")
def sorted_runs(spark, sf_dir):
    return levels.sorted_runs(files(spark, sf_dir))


@_query(_FILES + f", kept AS (SELECT count(*) AS n FROM ({_retained(1 << 56, True)})) SELECT CAST(floor(1000.0 * ((SELECT count(*) FROM ev) + (SELECT n FROM kept)) / (SELECT count(*) FROM ev)) AS BIGINT) AS write_amplification_thousandths")
def write_amplification(spark, sf_dir):
    """Entries written by flushes and one full compaction for each entry of the user, in thousandths."""
    user = events_log(spark, sf_dir).agg(F.count("*").alias("u"))
    kept = _kept(spark, sf_dir, 1 << 56, True).agg(F.count("*").alias("k"))
    return user.join(kept, F.lit(True)).select(F.floor(1000 * (F.col("u") + F.col("k")) / F.col("u")).alias("write_amplification_thousandths"))


@_query(f"""WITH {EVENTS_SQL}, r AS (SELECT user_key, CAST((SELECT max(seq) FROM ev) - seq AS BIGINT) // 2500 + CASE WHEN seq % 97 = 0 THEN 1 ELSE 0 END AS run, min(seq) AS low, max(seq) AS high FROM ev GROUP BY 1, 2),
a AS (SELECT *, min(low) OVER (PARTITION BY user_key ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM r) SELECT user_key, run, high, above FROM a WHERE above <= high""")
def invariant_seq_order(spark, sf_dir):
    """Every 97th entry lies a run too low, below older ones of its key: these are told."""
    log = events_log(spark, sf_dir)
    run = F.floor((F.lit(_fifths(spark, sf_dir, 5)) - F.col("seq")) / 2500) + F.when(F.col("seq") % 97 == 0, 1).otherwise(0)
    return levels.sequence_violations(log.withColumn("run", run))


@_query(_FILES + ", shifted AS (SELECT level + 1 AS level, file_num, smallest_key, lag(largest_key) OVER (PARTITION BY level ORDER BY smallest_key, file_num) AS before FROM files) SELECT level, file_num, smallest_key, before FROM shifted WHERE before >= smallest_key")
def check_ordering(spark, sf_dir):
    """All files moved down a level: those of level 0 overlap and are reported."""
    return levels.order_violations(files(spark, sf_dir).withColumn("level", F.col("level") + 1))


@_query(_FILES + "SELECT level, CAST(CASE WHEN level = 0 THEN floor(count(*) * 1000 / 4) ELSE floor(sum(n_entries) * 1000 / (10000 * pow(10, level - 1))) END AS BIGINT) AS score FROM files GROUP BY level")
def leveled_scores(spark, sf_dir):
    return levels.level_scores(files(spark, sf_dir), "n_entries", 4, 10_000, 10)


@_query(_FILES + "SELECT CAST(row_number() OVER (ORDER BY level, largest_seq DESC) AS INTEGER) - 1 AS run, level, n_files, size FROM (SELECT level, count(*) AS n_files, CAST(sum(n_entries) AS BIGINT) AS size, max(largest_seq) AS largest_seq FROM files GROUP BY level, CASE WHEN level = 0 THEN file_num ELSE -1 END)")
def tiered_runs(spark, sf_dir):
    """Sorted runs as the size-tiered planner orders them; sizes are counts of entries."""
    metas = [FileMeta(r["file_num"], r["level"], r["n_entries"], r["smallest_key"].encode(), r["largest_key"].encode(), r["smallest_seq"], r["largest_seq"]) for r in files(spark, sf_dir).collect()]  # a row a file
    rows = [(k, r[0].level, len(r), sum(f.size for f in r)) for k, r in enumerate(runs_of(metas, 7))]
    return spark.createDataFrame(rows, "run int, level int, n_files long, size long")


@_query(f"WITH {EVENTS_SQL}, {ORDERS_SQL} SELECT user_key, seq, CAST(kind AS INTEGER) AS kind FROM ev UNION ALL SELECT user_key, seq, CAST(kind AS INTEGER) FROM od")
def ordered_union(spark, sf_dir):
    return levels.ordered_union([events_log(spark, sf_dir), orders_log(spark, sf_dir)]).select("user_key", "seq", "kind")


# --- the store ------------------------------------------------------------------------------------------------------

QUERIES |= {f.__name__: f for f in examples.EXAMPLES}
_NATION = "SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS user_key, "
ORACLE_SQL |= {
    "store_tour": _resolved(None) + _COLUMNS,
    "stream_ingest": _resolved(None) + _COLUMNS,
    "stream_retry": _resolved(None) + _COLUMNS,
    "reader_during_compaction": _resolved(OLD) + _COLUMNS,
    "compact_range": _retained(1 << 56, True, more=f"WHERE user_key >= '{examples.LOWER}' AND user_key <= '{examples.UPPER}'"),
    "batch_last_op_wins": f"WITH {EVENTS_SQL} SELECT user_key, arg_max(value, seq) AS value FROM ev WHERE kind = 1 GROUP BY user_key",
    "batch_of_every_kind": _NATION + "CASE n_nationkey % 4 WHEN 0 THEN n_regionkey + 10 WHEN 1 THEN n_regionkey ELSE 7 END AS value FROM nation WHERE n_nationkey % 4 <> 3",
    "wal_recover": _NATION + "n_regionkey + CASE WHEN n_nationkey = 3 THEN 100 ELSE 0 END AS value FROM nation WHERE n_nationkey <> 4",
    "checkpoint_open": _NATION + "n_regionkey AS value FROM nation",
    "cursor_walk": _resolved(None)
    + """, k AS (SELECT *, row_number() OVER (ORDER BY user_key) - 1 AS place FROM res), w(step, place) AS (VALUES (0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 4), (6, 3))
SELECT CAST(step AS INTEGER) AS step, user_key, value FROM w JOIN k USING (place) UNION ALL SELECT 7, min(user_key), min_by(value, user_key) FROM res WHERE user_key >= 'u000100' HAVING count(*) > 0""",
}
