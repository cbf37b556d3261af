"""Which entries maintenance may drop without changing any read that is still allowed.

``horizon`` is the oldest sequence a reader may still ask for: entries above it stay, the newest at or below it decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.keys import found_at, key_cuts
from stratalog.functions.mergers import Merger
from stratalog.model import DELETE, MERGE, SET, SET_TTL

ENTRY_COLUMNS = ["user_key", "seq", "kind", "value", "expiry_ns"]


def _max_seq(where: Column) -> Column:
    return F.max(F.when(where, F.col("seq"))).over(Window.partitionBy("user_key"))


def flush_dedup(log: DataFrame, horizon: int) -> DataFrame:
    """A flush's rule: below the horizon, nothing older than the newest entry that is no operand; deletions stay."""
    base = _max_seq((F.col("seq") <= horizon) & (F.col("kind") != MERGE))
    return log.withColumn("_bs", base).where((F.col("seq") > horizon) | (F.col("seq") >= F.coalesce("_bs", F.lit(0)))).select(*ENTRY_COLUMNS)


def retain(log: DataFrame, horizon: int, now_ns: int, base: Column | bool = False, merger: Merger | None = None, remove: Callable[[Column, Column], Column] | None = None, snapshots: bool = False) -> DataFrame:
    """A compaction's rule.

    ``base``: nothing below the output may hold the key (a column or one answer for all), so deletions can go.
    ``remove``: from key and value, whether the newest version of a key is to go; asked only without open snapshots.
    Operands are folded onto a set or deletion, or at base level onto nothing, never onto an entry with a time to live.
    """
    base = F.lit(base) if isinstance(base, bool) else base
    below = F.col("seq") <= horizon
    kinds = F.max(F.when(F.col("seq") == F.col("_bs"), F.col("kind"))).over(Window.partitionBy("user_key"))
    marked = log.withColumns({"_top": _max_seq(below), "_bs": _max_seq(below & (F.col("kind") != MERGE)), "_newest": F.max("seq").over(Window.partitionBy("user_key")), "_base": base}).withColumn("_bk", kinds)
    kept = marked.where(~below | (F.col("seq") >= F.coalesce("_bs", F.lit(0))))
    has_ops = F.coalesce(F.col("_top") > F.coalesce("_bs", F.lit(0)), F.lit(False))
    can_fold = F.when(F.col("_bs").isNull(), F.col("_base")).otherwise(F.col("_bk") != SET_TTL)
    fold = (has_ops & can_fold) if merger is not None else F.lit(False)
    kept = kept.withColumns({"_fold": fold & below, "_decides": below & ~has_ops})

    gone = (F.col("kind") == DELETE) | ((F.col("kind") == SET_TTL) & (F.col("expiry_ns") <= now_ns))
    if remove is not None and not snapshots:
        gone = gone | (F.col("kind").isin(SET, SET_TTL) & (F.col("seq") == F.col("_newest")) & F.coalesce(remove(F.col("user_key"), F.col("value")), F.lit(False)))
    plain = kept.where(~F.col("_fold"))
    drop = F.col("_decides") & gone
    lone_delete = below & (F.col("kind") == DELETE) & F.col("_base")
    plain = plain.where(~((drop & F.col("_base")) | lone_delete))
    blank = lambda c: F.when(drop, F.lit(None)).otherwise(F.col(c)).alias(c)
    plain = plain.select("user_key", "seq", F.when(drop, F.lit(DELETE)).otherwise(F.col("kind")).cast(log.schema["kind"].dataType).alias("kind"), blank("value"), blank("expiry_ns"))
    if merger is None:
        return plain
    is_op = F.col("kind") == MERGE
    folded = kept.where("_fold").groupBy("user_key").agg(F.max("seq").alias("seq"), F.max(F.when(F.col("kind") == SET, F.struct("value"))).alias("b"), merger.operands(F.when(is_op, F.col("value")), F.when(is_op, F.col("seq"))).alias("ops"))
    full = merger.full(F.col("user_key"), F.col("b.value"), F.col("b").isNotNull(), F.col("ops"))
    value = full.cast("string").cast("binary") if log.schema["value"].dataType.typeName() == "binary" else full
    sets = folded.select("user_key", "seq", F.lit(SET).cast(log.schema["kind"].dataType).alias("kind"), value.cast(log.schema["value"].dataType).alias("value"), F.lit(None).cast("long").alias("expiry_ns"))
    return plain.unionByName(sets)


def base_keys(keys: DataFrame, below: DataFrame) -> DataFrame:
    """The distinct ``user_key`` of rows, each with ``is_base``: no file of ``below`` (smallest_key, largest_key) covers it.

    Keys and files are sorted together within ranges of keys. A key is covered if a file that begins at or before it
    reaches it; how far the files of earlier ranges reach, a row each, is handed on.
    """
    starts = below.where("smallest_key <= largest_key").select(F.col("smallest_key").alias("key"), F.lit(False).alias("asked"), F.col("largest_key").alias("hi"))
    asked = keys.select(F.col("user_key").alias("key"), F.lit(True).alias("asked"), F.lit(None).cast(starts.schema["hi"].dataType).alias("hi"))
    rows = starts.unionByName(asked).distinct()  # above the union: Spark's optimizer fails on a search pushed into its parts
    cuts = key_cuts(rows, "key")
    dealt = rows.withColumn("at", found_at(cuts, F.col("key")))
    reach = F.max("hi").over(Window.partitionBy("at").orderBy("key", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.max("top").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    handed = dealt.groupBy("at").agg(F.max("hi").alias("top")).select("at", before.alias("handed"))
    known = dealt.withColumn("reach", reach).where("asked").join(handed, "at")
    covered = F.coalesce(F.greatest("reach", "handed") >= F.col("key"), F.lit(False))
    return known.select(F.col("key").alias("user_key"), (~covered).alias("is_base"))


def base_flags(log: DataFrame, below: DataFrame) -> DataFrame:
    """``log`` with ``is_base`` of each entry's key; nothing covers a key that is null."""
    return log.join(base_keys(log, below), "user_key", "left").withColumn("is_base", F.coalesce("is_base", F.lit(True)))
