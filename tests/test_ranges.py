"""Ranges of files: keys and pairs against plain Python, and work that grows with the result."""

import random
import time

import duckdb
import pytest

from stratalog.catalogue import ORACLE_SQL, QUERIES
from stratalog.operators.levels import overlaps
from stratalog.operators.retention import base_flags, base_keys

FILES = "file_num long, level int, smallest_key string, largest_key string"


def some_files(seed, n, level=0, wide=40, numbers=None):
    r = random.Random(seed)
    out = []
    for k in range(n):
        lo = r.randrange(300)
        out.append((k if numbers is None else r.randrange(numbers), level, f"k{lo:04d}", f"k{lo + r.choice([0, 1, 5, wide]):04d}"))
    return out


@pytest.mark.parametrize("n", [0, 1, 60])
def test_base_keys_against_plain(spark, n):
    """Nested, touching and repeated ranges, ends that are keys, ranges without a key, backward ones and null keys."""
    files = [*some_files(n, n), (100, 0, None, None), (101, 0, "k0200", None), (102, 0, "k0350", "k0010")]
    log = [(f"k{k:04d}", k) for k in range(0, 400, 3)] + [(None, 7), ("", 8), ("k0100", 9), ("z", 10), (None, 11)]
    covered = lambda key: any(key is not None and lo is not None and hi is not None and lo <= key <= hi for _, _, lo, hi in files)
    rows, below = spark.createDataFrame(log, "user_key string, seq long"), spark.createDataFrame(files, FILES)
    by_text = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert by_text(base_keys(rows, below).collect()) == by_text({(k, not covered(k)) for k, _ in log})
    assert by_text(base_flags(rows, below).select("user_key", "seq", "is_base").collect()) == by_text((k, s, not covered(k)) for k, s in log)


def test_base_keys_many_files(spark):
    """A key costs no walk over all files: this many would take many minutes."""
    n = 3000
    below = spark.range(n).selectExpr("id as file_num", "1 as level", "lpad(id * 20, 8, '0') as smallest_key", "lpad(id * 20 + 9, 8, '0') as largest_key")
    keys = spark.range(n * 20).selectExpr("lpad(id, 8, '0') as user_key")
    began = time.perf_counter()
    got = base_flags(keys, below).groupBy("is_base").count().collect()
    assert {r["is_base"]: r["count"] for r in got} == {True: n * 10, False: n * 10}
    assert time.perf_counter() - began < 90


@pytest.mark.parametrize("n", [0, 1, 70])
def test_overlaps_against_plain(spark, n):
    """Two levels, ranges with equal ends, numbers listed twice, rows without a number, level or key."""
    files = [*some_files(n, n, numbers=max(1, n - 10)), *some_files(n + 1, n, level=1, wide=250), (None, 0, "k0001", "k0300"), (5, None, "k0001", "k0300"), (500, 0, None, None), *[(k, 2, "a", "z") for k in (3, 1, 2, 2)]]
    want = sorted((a[0], b[0]) for a in files for b in files if None not in (*a, *b) and a[1] == b[1] and a[0] < b[0] and a[2] <= b[3] and b[2] <= a[3])
    for block in (1, 7, 128):
        got = overlaps(spark.createDataFrame(files, FILES), block)
        assert got.columns == ["file_a", "file_b"] and sorted(tuple(r) for r in got.collect()) == want


def test_overlaps_of_wide_files(spark):
    """Files that cross many ranges of keys are paired once, not once a range: that would take many minutes."""
    n = 4000
    files = spark.range(n).selectExpr("id as file_num", "0 as level", "lpad(id, 8, '0') as smallest_key", "'9' as largest_key")
    spark.conf.set("spark.sql.shuffle.partitions", 300)
    began = time.perf_counter()
    try:
        assert overlaps(files).count() == n * (n - 1) // 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert time.perf_counter() - began < 90


def test_base_level_keys_with_more_partitions(spark):
    """Spark's optimizer failed on this plan with 12 partitions (key not found: smallest_key)."""
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for t in ("events", "orders"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    try:
        got = QUERIES["base_level_keys"](spark, folder).select("user_key", "is_base").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted(tuple(r) for r in got) == sorted(duck.sql(f"SELECT user_key, is_base FROM ({ORACLE_SQL['base_level_keys']})").fetchall())
