"""Relational operators over a store's files and levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.keys import found_at, key_cuts


def ordered_union(parts: list[DataFrame]) -> DataFrame:
    """Entries of all sources in the order of keys, newest first."""
    return reduce(DataFrame.unionByName, parts).orderBy("user_key", F.col("seq").desc())


def file_metadata(log: DataFrame, file_num, level=0) -> DataFrame:
    """Bounds and counts of the files that a column deals the entries to."""
    level = F.lit(level) if isinstance(level, int) else level
    return log.groupBy(file_num.alias("file_num"), level.alias("level")).agg(F.min("user_key").alias("smallest_key"), F.max("user_key").alias("largest_key"), F.min("seq").alias("smallest_seq"), F.max("seq").alias("largest_seq"), F.count("*").alias("n_entries"))


#: Files of a level whose numbers make one row when overlapping files are paired.
BLOCK = 128


def overlaps(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of files (a < b) of one level whose closed key ranges meet.

    In the order of smallest keys a file meets, of those after it, just the run up to its largest key. Places and ends
    of runs are counted within ranges of keys, how many files begin in earlier ones, a row each, is handed on; runs are
    read off blocks of file numbers, so the work grows with the files and the pairs that there are.
    """
    cuts = key_cuts(files, "smallest_key")
    own = files.where("level is not null and file_num is not null and smallest_key <= largest_key").select("level", "file_num", "smallest_key", "largest_key")
    sides = F.array(F.struct(F.col("smallest_key").alias("key"), F.lit(False).alias("end")), F.struct(F.col("largest_key").alias("key"), F.lit(True).alias("end")))
    marks = own.withColumn("side", F.explode(sides)).select(*own.columns, "side.key", "side.end", found_at(cuts, F.col("side.key")).alias("at"))
    starts = F.count(F.when(~F.col("end"), 1))
    within = starts.over(Window.partitionBy("level", "at").orderBy("key", "end", "file_num").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.sum("n").over(Window.partitionBy("level").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    handed = marks.groupBy("level", "at").agg(starts.alias("n")).select("level", "at", F.coalesce(before, F.lit(0)).alias("before"))
    placed = marks.withColumn("within", within).join(handed, ["level", "at"]).withColumn("place", F.col("within") + F.col("before"))

    # Equal rows have as many places; the run of a place begins after it.
    place = F.collect_list(F.when(~F.col("end"), F.col("place")))
    runs = placed.groupBy(*own.columns).agg(place.alias("places"), F.max(F.when(F.col("end"), F.col("place"))).alias("last")).select("level", "file_num", F.explode("places").alias("place"), "last").where("place < last")
    of = lambda c: F.floor(c / block)
    dealt = runs.withColumn("block", F.explode(F.sequence(of(F.col("place")), of(F.col("last") - 1))))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "level", "block")  # few rows that become many pairs: as many tasks as can be
    blocks = placed.where("not end").groupBy("level", of(F.col("place") - 1).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "file_num")))["file_num"].alias("numbers"))
    first = F.greatest(F.col("place") - F.col("block") * block, F.lit(0))
    last = F.least(F.col("last") - F.col("block") * block, F.lit(block))
    met = dealt.join(blocks, ["level", "block"]).select("file_num", F.explode(F.slice("numbers", (first + 1).cast("int"), (last - first).cast("int"))).alias("other"))
    return met.where("file_num <> other").select(F.least("file_num", "other").alias("file_a"), F.greatest("file_num", "other").alias("file_b"))


def obsolete(listing: DataFrame, live: DataFrame) -> DataFrame:
    """Listed files that no live version names."""
    return listing.join(live, "file_num", "left_anti")


def live_files(versions: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, versions).distinct()


def apply_edit(version: DataFrame, deleted: DataFrame, added: DataFrame) -> DataFrame:
    """A version's files without the deleted and with the added ones."""
    return version.exceptAll(deleted).unionByName(added)


def double_listed(version: DataFrame) -> DataFrame:
    """File numbers that a version has more than once."""
    return version.groupBy("file_num").agg(F.count("*").alias("n")).where("n > 1")


def sequence_violations(log: DataFrame, rank: str = "run") -> DataFrame:
    """Keys that break the order of runs (0 newest): an entry as new as one of a newer run, per key and run."""
    runs = log.groupBy("user_key", F.col(rank).alias("run")).agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    above = F.min("low").over(Window.partitionBy("user_key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("above", above).where("above <= high").select("user_key", "run", "high", "above")


def order_violations(files: DataFrame) -> DataFrame:
    """Files of a level from 1 on whose range doesn't begin after the file before it.

    Files are compared within ranges of keys; the last of a level in a range, a row each, is handed on to the next.
    """
    cuts = key_cuts(files, "smallest_key")
    own = files.where("level > 0").select("level", "file_num", "smallest_key", "largest_key", found_at(cuts, F.col("smallest_key")).alias("at"))
    within = F.lag("largest_key").over(Window.partitionBy("level", "at").orderBy("smallest_key", "file_num"))
    last = own.groupBy("level", "at").agg(F.max_by("largest_key", F.struct("smallest_key", "file_num")).alias("handed"))
    handed = last.select("level", F.lead("at").over(Window.partitionBy("level").orderBy("at")).alias("at"), "handed").where("at is not null")
    joined = own.withColumn("before", within).join(handed, ["level", "at"], "left").withColumn("before", F.coalesce("before", "handed"))
    return joined.where("before >= smallest_key").select("level", "file_num", "smallest_key", "before")


def level_metrics(files: DataFrame, size: str = "n_entries") -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum(size).alias("size"), F.min("smallest_seq").alias("smallest_seq"), F.max("largest_seq").alias("largest_seq"))


def sorted_runs(files: DataFrame) -> DataFrame:
    """Files of level 0 and deeper levels that have any."""
    return files.agg((F.count(F.when(F.col("level") == 0, 1)) + F.count_distinct(F.when(F.col("level") > 0, F.col("level")))).alias("sorted_runs"))


def level_scores(files: DataFrame, size: str, trigger: int, l1_max: int, multiplier: int) -> DataFrame:
    """Per level the score of levelled compaction in thousandths: files over the trigger, bytes over the level's limit."""
    per = files.groupBy("level").agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    limit = F.lit(l1_max) * F.pow(F.lit(multiplier), F.col("level") - 1)
    return per.select("level", F.when(F.col("level") == 0, F.floor(F.col("n") * 1000 / F.lit(trigger))).otherwise(F.floor(F.col("size") * 1000 / limit)).cast("long").alias("score"))
