"""What a read at a sequence number and a clock sees.

For each key the newest entry that is no merge operand decides, together with the operands above it. Bounds on the key
and the sequence go below this operator, to the scan; conditions on the value must stay above it, or hidden versions
would come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.mergers import Merger
from stratalog.model import DELETE, MERGE, SET, SET_TTL


#: Sequence numbers whose entries of one key a task may have to hold.
BLOCK = 1 << 20


def live(kind: Column, expiry: Column, now_ns: int) -> Column:
    """A set entry, or one with a time to live that isn't over; at its expiry it is."""
    return F.coalesce((kind == SET) | ((kind == SET_TTL) & (F.lit(now_ns) < expiry)), F.lit(False))


def visible(log: DataFrame, seq: int | None = None) -> DataFrame:
    return log if seq is None else log.where(F.col("seq") <= seq)


def newest(log: DataFrame) -> DataFrame:
    """Per key the newest entry: user_key and ``b`` (seq, kind, value, expiry_ns); combined map-side."""
    return log.groupBy("user_key").agg(F.max_by(F.struct("seq", "kind", "value", "expiry_ns"), "seq").alias("b"))


def resolve(log: DataFrame, seq: int | None = None, now_ns: int = 0, merger: Merger | None = None, merges: bool = True, skewed: bool = False, block: int = BLOCK) -> DataFrame:
    """Live keys and values (user_key, value) as of ``seq`` and ``now_ns``.

    ``merges=False`` says that the log has no operands: one aggregate. Else one shuffle by key finds each key's base
    and folds its operands. ``skewed``: keys may hold a large part of all rows; they are then dealt by key and block of
    ``block`` sequence numbers, each block is folded by itself, and a key's blocks, a row each, are put together, so
    that no task sees more entries of a key than a block has. Operands without a merger fail the query.
    """
    log = visible(log, seq)
    if not merges:
        return newest(log).where(live(F.col("b.kind"), F.col("b.expiry_ns"), now_ns)).select("user_key", F.col("b.value").alias("value"))
    by = ["user_key", "_block"] if skewed else ["user_key"]
    rows = log.withColumn("_block", F.floor(F.col("seq") / block)) if skewed else log
    based = rows.withColumn("base_seq", F.max(F.when(F.col("kind") != MERGE, F.col("seq"))).over(Window.partitionBy(*by)))
    kept = based.where(F.col("seq") >= F.coalesce("base_seq", F.lit(0)))
    is_base, is_op = F.col("seq") == F.col("base_seq"), F.col("kind") == MERGE
    value, place = F.when(is_op, F.col("value")), F.when(is_op, F.col("seq"))
    ops = merger.operands(value, place) if merger is not None else F.max(F.lit(None).cast("int"))
    one = kept.groupBy(*by).agg(F.max(F.when(is_base, F.struct("kind", "value", "expiry_ns"))).alias("b"), F.count(F.when(is_op, F.lit(1))).alias("n_ops"), ops.alias("ops"))
    if skewed:
        # Only blocks from the last one with a base on count; it has what is above that base already.
        from_block = F.max(F.when(F.col("b").isNotNull(), F.col("_block"))).over(Window.partitionBy("user_key"))
        last = one.withColumn("_from", from_block).where(F.col("_block") >= F.coalesce("_from", F.col("_block")))
        together = merger.combine(F.col("ops"), F.col("_block")) if merger is not None else F.max("ops")
        one = last.groupBy("user_key").agg(F.max("b").alias("b"), F.sum("n_ops").alias("n_ops"), together.alias("ops"))
    exists = live(F.col("b.kind"), F.col("b.expiry_ns"), now_ns)
    has_ops = F.col("n_ops") > 0
    kind = log.schema["value"].dataType
    if merger is None:
        full = F.raise_error(F.lit("merge operands but no merger"))
        return one.where(has_ops | exists).select("user_key", F.when(has_ops, full.cast(kind)).otherwise(F.col("b.value")).alias("value"))
    folded = merger.full(F.col("user_key"), F.col("b.value"), exists, F.col("ops"))
    if kind.typeName() == "binary":
        folded = F.coalesce(folded.cast("string").cast("binary"), F.lit(b""))
    target = merger.result_type(kind)
    return one.where(has_ops | exists).select("user_key", F.when(has_ops, folded.cast(target)).otherwise(F.col("b.value").cast(target)).alias("value"))


def tombstoned(log: DataFrame, seq: int | None = None) -> DataFrame:
    """Keys whose newest entry is a deletion."""
    return newest(visible(log, seq)).where(F.col("b.kind") == DELETE).select("user_key", F.col("b.seq").alias("seq"))


def expired(log: DataFrame, seq: int | None = None, now_ns: int = 0) -> DataFrame:
    """Keys whose newest entry has outlived its time to live."""
    return newest(visible(log, seq)).where((F.col("b.kind") == SET_TTL) & (F.col("b.expiry_ns") <= now_ns)).select("user_key", F.col("b.expiry_ns").alias("expiry_ns"))


def history(log: DataFrame, key) -> DataFrame:
    """All versions of a key, newest first."""
    return log.where(F.col("user_key") == F.lit(key)).orderBy(F.col("seq").desc())


def difference(log: DataFrame, old: int, new: int, now_ns: int, merger: Merger | None = None) -> DataFrame:
    """Keys whose visible value differs between two snapshots: user_key, old_value, new_value."""
    a = resolve(log, old, now_ns, merger).select("user_key", F.col("value").alias("old_value"))
    b = resolve(log, new, now_ns, merger).select("user_key", F.col("value").alias("new_value"))
    return a.join(b, "user_key", "full").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
