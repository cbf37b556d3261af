"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash. For each source the words are summed by the leading bits of the hash; the bucket in
which the source's budget ends is found from that histogram and only its documents are looked at again by the next
bits, until one document is left at the boundary. The mix is then a filter ``hash < threshold``: nothing is sorted,
and a larger budget always holds all that a smaller one does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm._common import column, fresh, prepare, written

WORD = r"[^\x20\x09-\x0D]+"
#: Bits that one histogram splits, and rounds of them; together they are all bits of the hash that count.
BITS, ROUNDS = 10, 6
#: Sources up to which their table of thresholds is sent to every executor; beyond it a join shuffles by source.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``target`` for each row of (source, source_size): ``share`` of all sizes by weights that repeat over the sources
    in code point order (null last); what is above ``most`` times a source's size is reshared until none is above.

    Works on any number of sources: ranks come from a range partitioning, and the water level is found by sums.
    """
    spark = sources.sparkSession
    parts = max(1, min(32, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordered = sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranked = written(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "sources")
    before, rank = 0, F.lit(0).cast("long")
    for part, n in sorted((r["part"], r["n"]) for r in ranked.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row a partition
        rank = F.when(F.col("part") == part, F.lit(before) + F.col("at")).otherwise(rank)
        before += n
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights))).cast("int"))
    weighed = ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    budget = float(share) * float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # the set of capped sources only grows, so this ends
        capped = F.col("cap") <= F.lit(level) * F.col("w")
        held, free, n = weighed.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0.0)), F.coalesce(F.sum(capped.cast("long")), F.lit(0))).first()
        if n == full or free == 0:
            break
        full, level = n, (budget - held) / free
    return weighed.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target")) if free else weighed.select("source", "source_size", F.col("cap").alias("target"))


def _hash(key: Column, text: Column) -> Column:
    """The fixed hash of a document, BITS * ROUNDS bits: of its key, or of its text where the key is null."""
    return F.shiftrightunsigned(F.when(key.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)), 64 - BITS * ROUNDS)


def _times(hash_: Column, times: Column, lo: Column, most: int) -> Column:
    """How often the mix takes a document: the whole repeats, and once more below the threshold."""
    return F.least(times + (hash_ < lo).cast("long"), F.lit(most).cast("long"))


def _thresholds(narrow: DataFrame, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, Callable]:
    """(of, source_size, target, times, lo) of each source in rows of (source, size, hash), and how to join it: a
    source takes each document ``times`` times, and once more those whose hash is below ``lo``."""
    sources = written(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumn("times", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")).withColumn("left", F.greatest(F.col("target") - F.col("times") * F.col("source_size"), F.lit(0.0))), "targets")
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda x: x)

    # lo: the hash where the boundary bucket begins; left: the budget that remains from there on.
    edge = sources.select(F.col("source").alias("s"), F.lit(0).cast("long").alias("lo"), "left", F.lit(False).alias("done"))
    for r in range(ROUNDS):
        width = BITS * (ROUNDS - r - 1)
        open_ = narrow.where("size > 0").join(small(edge.where("not done")), F.col("source").eqNullSafe(F.col("s")) & (F.shiftrightunsigned("hash", width + BITS) == F.shiftrightunsigned("lo", width + BITS)))
        bars = open_.groupBy("s", F.shiftrightunsigned("hash", width).alias("b")).agg(F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        sums = F.sum("words").over(Window.partitionBy("s").orderBy("b"))
        # The first bucket that doesn't fit whole; a source has 2**BITS of them at most.
        cut = bars.withColumn("upto", sums).join(small(edge.where("not done").select(F.col("s").alias("t"), "left")), F.col("s").eqNullSafe(F.col("t"))).where("upto > left").groupBy("s").agg(F.min_by(F.struct("b", "words", "upto", "left", "low", "high"), "b").alias("c"))
        room = F.col("c.left") - (F.col("c.upto") - F.col("c.words"))
        single = F.col("c.low") == F.col("c.high")
        found = cut.select(F.col("s").alias("t"), F.when(single, F.when(room * 2 >= F.col("c.words"), F.col("c.low") + 1).otherwise(F.col("c.low"))).otherwise(F.shiftleft(F.col("c.b"), width)).alias("lo2"), room.alias("left2"), single.alias("done2"))
        # No bucket passes the budget: all of what is open fits.
        everything = F.shiftleft(F.shiftrightunsigned("lo", width + BITS) + 1, width + BITS)
        edge = written(edge.join(small(found), F.col("s").eqNullSafe(F.col("t")), "left").select("s", F.when(F.col("done"), F.col("lo")).otherwise(F.coalesce("lo2", everything)).alias("lo"), F.coalesce("left2", "left").alias("left"), F.coalesce("done2", F.lit(True)).alias("done")), f"edge{r}")
        if not edge.where("not done").limit(1).count():
            break
    plan = sources.join(small(edge.select("s", "lo")), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("of"), "source_size", "target", "times", "lo")
    return written(plan, "thresholds"), small


def _narrow(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Size and hash of each document, written once, as every round reads them."""
    key_col, text_col = column(docs, key), column(docs, text)
    return written(docs.select(key_col.alias("key"), column(docs, source).alias("source"), word_count(text_col).alias("size"), _hash(key_col, text_col).alias("hash")), "sizes")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Per document: key, ``size``, ``source_size``, ``target`` (its source's) and ``taken``.

    A source whose target is r times its size takes each document floor(r) times, and once more those whose hash is
    below the source's threshold. At the boundary the document is in if that brings the sum nearer to the target.
    Null texts have size 0; null is a source of its own; rows with one key share a hash and so a decision, rows with a
    null key if their text is the same. Texts of any length are counted whole. An empty table gives an empty result;
    columns beside these three, whatever their names, are not read. Reruns agree.
    """
    prepare(docs.sparkSession)
    narrow = _narrow(docs, key, text, source)
    plan, small = _thresholds(narrow, weights, share, most)
    taken = F.col("size") * _times(F.col("hash"), F.col("times"), F.col("lo"), most)
    return narrow.join(small(plan), F.col("source").eqNullSafe(F.col("of"))).select(F.col("key").alias(key), "size", "source_size", "target", taken.alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, columns unchanged, whatever their names.

    The thresholds of :func:`mix_sources` are joined to the documents by source, so no text is shuffled while sources
    are few enough to be broadcast. Documents of size 0 cost nothing and stay once; an empty table stays empty.
    """
    prepare(docs.sparkSession)
    plan, small = _thresholds(_narrow(docs, "doc_id", "text", "source"), weights, share, most)
    of, times, lo, copy = fresh(docs, "mix_of", "mix_times", "mix_lo", "mix_copy")
    plan = plan.select(F.col("of").alias(of), F.col("times").alias(times), F.col("lo").alias(lo))
    key, text = column(docs, "doc_id"), column(docs, "text")
    joined = docs.join(small(plan), column(docs, "source").eqNullSafe(F.col(of)))
    n = F.when(F.coalesce(F.regexp_like(text, F.lit(WORD)), F.lit(False)), _times(_hash(key, text), F.col(times), F.col(lo), most)).otherwise(1)
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), n.cast("int")))).select(*[column(docs, c) for c in docs.columns])
