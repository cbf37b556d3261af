"""Random histories against a plain model, and what maintenance may not change."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions import key_filter
from stratalog.functions.keys import decode_long, encode_long, prefix_bounds
from stratalog.functions.mergers import AppendMerger, SumMerger, UdfMerger
from stratalog.model import DELETE, MERGE, SET, SET_TTL
from stratalog.operators.resolve import resolve
from stratalog.operators.retention import flush_dedup, retain
from stratalog.operators.scan import Reader

SCHEMA = "user_key string, seq long, kind int, value long, expiry_ns long"


def history(seed, n=600, keys=40):
    r = random.Random(seed)
    out = []
    for seq in range(1, n + 1):
        kind = r.choice([DELETE, SET, MERGE, MERGE, SET_TTL])
        out.append((f"k{r.randrange(keys):03d}", seq, kind, None if kind == DELETE else r.randrange(100), r.randrange(1, 200) if kind == SET_TTL else None))
    return out


def model(rows, seq, now, merge):
    keys = {}
    for k, s, kind, v, e in sorted(rows, key=lambda x: x[1]):
        if s <= seq:
            base, ops = keys.get(k, (None, []))
            keys[k] = (base, [*ops, v]) if kind == MERGE else ((kind, v, e), [])
    out = {}
    for k, (base, ops) in keys.items():
        alive = base is not None and (base[0] == SET or (base[0] == SET_TTL and now < base[2]))
        if ops:
            out[k] = merge(base[1] if alive else None, ops)
        elif alive:
            out[k] = base[1]
    return out


def total(existing, ops):
    return (existing or 0) + sum(ops)


def read(df):
    return {r["user_key"]: r["value"] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_resolve_against_model(spark, seed):
    rows = history(seed)
    log = spark.createDataFrame(rows, SCHEMA)
    for seq, now in ((600, 100), (300, 0), (450, 199)):
        assert read(resolve(log, seq, now, SumMerger())) == model(rows, seq, now, total)
        assert read(resolve(log, seq, now, SumMerger(), skewed=True)) == model(rows, seq, now, total)
    joined = lambda e, ops: ",".join(map(str, ([] if e is None else [e]) + ops))
    assert read(resolve(log, 600, 100, AppendMerger())) == {k: str(v) for k, v in model(rows, 600, 100, joined).items()}
    last = lambda e, ops: ops[-1] - (e or 0)
    assert read(resolve(log, 600, 100, UdfMerger(lambda k, e, x, o: o[-1] - (e or 0), "long"))) == model(rows, 600, 100, last)


def test_operand_without_merger(spark):
    log = spark.createDataFrame([("a", 1, MERGE, 1, None)], SCHEMA)
    with pytest.raises(Exception, match="no merger"):
        resolve(log).collect()


@pytest.mark.parametrize("base", [True, False])
def test_maintenance_keeps_reads(spark, base):
    rows = history(7)
    log = spark.createDataFrame(rows, SCHEMA)
    for horizon in (250, 600):
        kept = retain(log, horizon, 50, base, SumMerger()).cache()
        thin = flush_dedup(log, horizon).cache()
        assert kept.count() <= thin.count() < len(rows)
        for seq in (horizon, 600):
            want = model(rows, seq, 120, total)
            assert read(resolve(kept, seq, 120, SumMerger())) == want
            assert read(resolve(thin, seq, 120, SumMerger())) == want


def test_empty_log(spark):
    log = spark.createDataFrame([], SCHEMA)
    assert resolve(log, 5, 0, SumMerger()).count() == 0 and retain(log, 5, 0, True, SumMerger()).count() == 0


def test_scans_and_cursor(spark):
    rows = history(3)
    want = sorted(model(rows, 600, 100, total).items())
    reader = Reader(spark.createDataFrame(rows, SCHEMA), 600, 100, SumMerger())
    assert [tuple(r) for r in reader.scan().collect()] == want
    assert [tuple(r) for r in reader.scan(reverse=True).collect()] == want[::-1]
    cursor = reader.cursor(page=7)
    assert list(cursor.all()) == want
    assert not cursor.next() and not cursor.prev()
    assert cursor.seek_lt("zzz") and cursor.key() == want[-1][0]
    assert cursor.prev() and cursor.key() == want[-2][0] and cursor.next() and cursor.key() == want[-1][0]
    assert reader.scan("k010", "k010").count() == 0 and reader.scan(upper="").count() == 0


def test_plans(spark, tmp_path):
    spark.createDataFrame(history(1), SCHEMA).write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plan = text(Reader(log, 300, 0, SumMerger()).get("k001"))
    assert "EqualTo(user_key,k001)" in plan and "LessThanOrEqual(seq,300)" in plan
    assert text(resolve(log, 300, 0, SumMerger())).count("Exchange hashpartitioning") == 1
    assert "TakeOrderedAndProject" in text(Reader(log, 300, 0, SumMerger()).first())


def test_keys(spark):
    assert prefix_bounds(b"ab") == (b"ab", b"ac") and prefix_bounds(b"a\xff") == (b"a\xff", b"b") and prefix_bounds(b"") == (b"", None)
    numbers = [-(1 << 63), -5, 0, 7, (1 << 63) - 1]
    df = spark.createDataFrame([(n,) for n in reversed(numbers)], "n long").select("n", encode_long(F.col("n")).alias("b"))
    assert [r["n"] for r in df.orderBy("b").collect()] == numbers
    assert [r["m"] for r in df.orderBy("b").select(decode_long(F.col("b")).alias("m")).collect()] == numbers


def test_key_filter(spark):
    bits, probes = key_filter.shape(2000)
    words = key_filter.build(spark.range(2000).select(F.col("id").alias("k")), "k", bits, probes)
    assert key_filter.may_contain(spark.range(2000).select(F.col("id").alias("k")), "k", words, bits, probes).count() == 2000
    wrong = key_filter.may_contain(spark.range(10_000, 30_000).select(F.col("id").alias("k")), "k", words, bits, probes).count()
    assert wrong / 20_000 < 0.015
