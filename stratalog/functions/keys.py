"""Key codecs and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefix_bounds(prefix: bytes) -> tuple[bytes, bytes | None]:
    """Half-open bounds of all keys with a prefix; no upper bound if it is empty or all 0xff."""
    trimmed = prefix.rstrip(b"\xff")
    return prefix, trimmed[:-1] + bytes([trimmed[-1] + 1]) if trimmed else None


def key_cuts(rows: DataFrame, column: str) -> list:
    """Keys that cut those of a column into about as many ranges as a shuffle has partitions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select(F.col(column).alias("k")).where("k is not null").repartitionByRange(parts, "k")
    least = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k"))
    return sorted(r["k"] for r in least.collect())[1:]  # a row a partition


def found_at(bounds: list | Column, key: Column) -> Column:
    """How many of the bounds, an ascending list or array, are not above a key: a binary search, which needs no join."""
    own = F.lit(bounds) if isinstance(bounds, list) else bounds
    ends = F.struct(F.lit(0).alias("lo"), F.size(own).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.get(own, middle) <= key
        open_ = acc["lo"] < acc["hi"]
        return F.struct(F.when(open_ & below, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~below, middle).otherwise(acc["hi"]).alias("hi"))

    steps = max(1, len(bounds).bit_length()) if isinstance(bounds, list) else 31
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ends, halve, lambda acc: acc["lo"]) if not isinstance(bounds, list) or bounds else F.lit(0)


def encode_long(number: Column) -> Column:
    """Eight big-endian bytes whose unsigned order is that of signed numbers."""
    return F.unhex(F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def decode_long(data: Column) -> Column:
    high, low = F.conv(F.substring(F.hex(data), 1, 8), 16, 10).cast("long"), F.conv(F.substring(F.hex(data), 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low).bitwiseXOR(F.lit(-(1 << 63)))


def decode_decimal(data: Column) -> Column:
    """Decimal text as a number."""
    return data.cast("string").cast("long")


def encode_decimal(number: Column) -> Column:
    return number.cast("string").cast("binary")
