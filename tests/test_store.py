import pytest

from stratalog.functions.keys import decode_decimal, encode_decimal
from stratalog.functions.mergers import SumMerger
from stratalog.model import BatchTooLarge, Corruption, Exists, ForeignSnapshot, InvalidOptions, KeyTooLarge, Locked, NoMerger, NotFound, Options
from stratalog.plans import compaction as plan
from stratalog.plans.compaction import FileMeta
from stratalog.sources.batch import Batch
from stratalog.sources.store import Store, format_bytes


def options(**more):
    return Options(**({"merger": SumMerger(decode_decimal, encode_decimal), "clock": lambda: 1000} | more))


def values(df):
    return [(bytes(r["user_key"]), bytes(r["value"])) for r in df.collect()]


def test_reads_and_snapshots(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/s", options()) as s:
        s.put(b"a", b"1")
        s.put(b"", b"")
        snap = s.snapshot()
        s.write(Batch().put(b"a", b"2").put(b"a", b"3").merge(b"n", b"5").merge(b"n", b"6").put_with_expiry(b"t", b"x", 1000))
        s.delete(b"nothing")
        s.flush()
        s.put(b"b", b"4")
        assert s.get(b"a") == b"3" and s.get(b"a", snap) == b"1" and s.get(b"") == b"" and s.get(b"n") == b"11"
        with pytest.raises(NotFound):
            s.get(b"t")
        assert values(s.scan()) == [(b"", b""), (b"a", b"3"), (b"b", b"4"), (b"n", b"11")]
        assert values(s.scan(b"a", b"b")) == [(b"a", b"3")]
        s.compact_range()
        assert s.get(b"a", snap) == b"1"
        snap.release()
        snap.release()
        with pytest.raises(ForeignSnapshot):
            s.get(b"a", snap)
        s.compact_range()
        assert values(s.scan()) == [(b"", b""), (b"a", b"3"), (b"b", b"4"), (b"n", b"11")]
        assert s.dump().count() == 4 and s.metrics()["sorted_runs"] == 1 and "L" in s.metrics_text()
        s.check()


def test_faults(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    with Store(spark, path, Options()) as s:
        with pytest.raises(NoMerger):
            s.merge(b"a", b"1")
        with pytest.raises(KeyTooLarge):
            s.put(b"x" * 65_537, b"")
        s.put(b"x" * 65_536, b"ok")
        big = Batch()
        big._bytes = (64 << 20) + 1
        with pytest.raises(BatchTooLarge):
            big.validate(None)
        with pytest.raises(Locked):
            Store(spark, path)
        assert s.write(Batch()) == 1
        s.checkpoint(f"file://{tmp_path}/copy")
        with pytest.raises(Exists):
            s.checkpoint(f"file://{tmp_path}/copy")
    with Store(spark, f"file://{tmp_path}/copy") as c:
        assert c.get(b"x" * 65_536) == b"ok"
    with pytest.raises(Exists):
        Store(spark, path, Options(error_if_exists=True))
    with pytest.raises(InvalidOptions):
        Store(spark, path, Options(num_levels=9))
    with pytest.raises(Corruption):
        from stratalog.model import Comparer

        Store(spark, path, Options(comparer=Comparer("other")))


def test_only_bytewise_order(spark, tmp_path):
    """No other order of keys is built: a comparer with one must not be taken and then ignored."""
    from stratalog.model import Comparer

    with pytest.raises(InvalidOptions):
        Store(spark, f"file://{tmp_path}/s", Options(comparer=Comparer("reverse", lambda c: -c)))


def test_damaged_logs(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    with Store(spark, path, Options()) as s:
        for i in range(4):
            s.put(b"%d" % i, b"v")
    logs = sorted((tmp_path / "s/wal").glob("*.json"))
    logs[-1].write_text("torn")
    (tmp_path / "s/manifest/99999999.json").write_text("{")
    with Store(spark, path, Options(disable_automatic_compactions=True)) as s:
        assert [k for k, _ in values(s.scan())] == [b"0", b"1", b"2"]
        for i in range(3):
            s.put(b"n%d" % i, b"v")
    logs = sorted((tmp_path / "s/wal").glob("*.json"))
    logs[0].write_text("damaged")
    with pytest.raises(Corruption):
        Store(spark, path)
    with Store(spark, path, Options(best_effort_recovery=True)) as s:
        assert [k for k, _ in values(s.scan())] == [b"0", b"1", b"2", b"n1", b"n2"]
        number = next(iter(s.version))
        s.files.delete(s._segment(number))
    with pytest.raises(Corruption):
        Store(spark, path)


def file(n, level, low, high, size=100, seq=None):
    return FileMeta(n, level, size, low, high, seq or n, seq or n, 1)


def test_planners():
    o = Options(l0_compaction_trigger=2, l1_max_bytes=150)
    zero = [file(1, 0, b"a", b"c"), file(2, 0, b"b", b"f"), file(3, 0, b"x", b"z")]
    below = [file(4, 1, b"e", b"g"), file(5, 1, b"m", b"n")]
    p = plan.pick_leveled(zero + below, o)
    assert {f.file_num for f in p.inputs} == {1, 2, 4} and p.level == 1 and not p.move
    p = plan.pick_leveled(below, o, {1: b"g"})
    assert [f.file_num for f in p.inputs] == [5] and p.move and p.level == 2
    assert plan.pick_leveled(zero[:1], o) is None
    assert plan.pick_manual(zero, None, None) == [(0, 1)] and plan.pick_manual(below, b"a", b"b") == []
    assert plan.pick_manual(zero + below, None, None) == [(0, 1), (1, 1)]
    assert plan.flush_level([], b"a", b"b", o) == 2 and plan.flush_level(zero, b"a", b"b", o) == 0
    even = [file(n, 0, b"a", b"z") for n in range(1, 6)]
    assert len(plan.pick_tiered(even, o).inputs) == 5 and plan.pick_tiered(even[:1], o) is None
    assert format_bytes(1536) == "1.5 KiB" and format_bytes(5) == "5 B"


def test_tiered_store(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/s", options(strategy="tiered", tiered_width=2)) as s:
        for i in range(4):
            s.put(b"k%d" % i, b"%d" % i)
            s.flush()
        assert len(values(s.scan())) == 4 and s.metrics()["compactions"] > 0
