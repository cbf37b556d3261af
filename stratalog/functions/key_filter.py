"""A Bloom filter of keys as a distributed aggregate and a column predicate.

Segments rely on Parquet's own filters; this one answers for whole key sets, where a semi-join is to be thinned out
before its shuffle. Its size is set by a count of keys and never grows with rows. It is cut into blocks of a fixed size,
of which a key uses one, so that neither building nor asking it needs the whole in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BLOCK_BITS = 1 << 13


def shape(keys: int, bits_per_key: int = 10) -> tuple[int, int]:
    """Bits, a multiple of BLOCK_BITS, and probes: round(bits * ln 2) probes within 1 to 30."""
    return -(-max(64, keys * bits_per_key) // BLOCK_BITS) * BLOCK_BITS, min(30, max(1, round(bits_per_key * math.log(2))))


def _block(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(bits // BLOCK_BITS))


def _places(key: Column, probes: int) -> Column:
    """Bits of a key within its block."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS)).cast("int") for i in range(probes)])


def build(keys: DataFrame, column: str, bits: int, probes: int) -> DataFrame:
    """The filter's blocks (block, words): arrays of 64-bit words, at most bits / BLOCK_BITS rows."""
    at = keys.select(_block(F.col(column), bits).alias("block"), F.explode(_places(F.col(column), probes)).alias("bit"))
    words = at.groupBy("block", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("mask"))
    rows = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("long")))
    return rows.select("block", full.alias("words"))


def may_contain(rows: DataFrame, column: str, blocks: DataFrame, bits: int, probes: int) -> DataFrame:
    """Rows whose key may be in the filter. A key's bits lie in one block of 1 KiB, so rows are joined with blocks by
    number; Spark broadcasts the blocks if they are small enough."""
    mine, block, words = "_filter_block", "_filter_of", "_filter_words"
    table = blocks.select(F.col("block").alias(block), F.col("words").alias(words))
    hit = F.forall(_places(F.col(column), probes), lambda b: F.get(words, F.shiftright(b, 6)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)))) != 0)
    return rows.withColumn(mine, _block(F.col(column), bits)).join(table, F.col(mine) == F.col(block)).where(hit).drop(mine, block, words)
