import threading

import numpy as np
import pytest

from ledgerlark.streaming import versions
from ledgerlark.streaming.versions import Conflict, VersionedTable, bloom, may_hold

SCHEMA = "id string, n long, member string"


def rows(spark, keys, n=0):
    return spark.createDataFrame([(k, n, None) for k in keys], SCHEMA)


def held(table, version=None):
    return {r.id: r.n for r in table.read(version).collect()}


def test_bloom_filters_lose_no_key():
    rng = np.random.default_rng(1)
    own, other = rng.integers(-(2**63), 2**63, 5000), rng.integers(-(2**63), 2**63, 5000)
    filter_ = bloom(own)
    assert may_hold(filter_, own).all() and may_hold(filter_, other).mean() < 0.02
    assert not may_hold(bloom(own[:0]), other).any() and may_hold(filter_, own[:0]).shape == (0,)


def test_merges_rewrite_only_files_that_hold_their_keys(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", SCHEMA, buckets=32, most_files=4)
    first = [f"k{k}" for k in range(2000)]
    assert table.merge(rows(spark, first)) == {"version": 1, "files": 0, "rewritten": 0, "rows_read": 0, "rows_written": 2000}
    told = table.merge(rows(spark, ["k7"], 1))
    assert told["files"] == 32 and told["rewritten"] == 1 and told["rows_read"] < 200 and told["rows_written"] == told["rows_read"]
    news = table.merge(rows(spark, [f"new{k}" for k in range(40)], 2))  # keys that no file holds are written beside
    assert news["rewritten"] <= 3 and news["rows_written"] < 400
    assert held(table) == {k: int(k == "k7") for k in first} | {f"new{k}": 2 for k in range(40)}
    assert held(table, 1) == dict.fromkeys(first, 0) and table.latest() == 3
    for n in range(3, 8):  # crowded buckets are put together
        table.merge(rows(spark, [f"more{n}-{k}" for k in range(60)], n))
    assert max(r["count"] for r in table.manifest().groupBy("bucket").count().collect()) <= 5 and len(held(table)) == 2340


def test_last_row_of_a_key_null_keys_and_no_rows(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", SCHEMA, buckets=4)
    df = spark.createDataFrame([("a", 1, None), ("a", 5, None), ("a", 3, None), (None, 9, None), ("b", None, "x")], SCHEMA)
    table.merge(df, sequence="n")
    assert held(table) == {"a": 5, "b": None}
    assert table.merge(df.limit(0))["version"] == 1 and table.latest() == 1 and table.read(0).count() == 0


def test_versions_are_compared_by_their_trees(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", SCHEMA, buckets=64)
    table.merge(rows(spark, [f"k{k}" for k in range(800)]))
    table.merge(rows(spark, ["k3", "k700"], 1).union(rows(spark, ["new"], 1)))
    table.merge(rows(spark, ["k5"]))  # written again as it was
    assert table.delete(lambda df: df.filter("id IN ('k9', 'k10')")) == 4
    assert sorted(tuple(r) for r in table.changes(1, 4).collect()) == [("k10", "removed"), ("k3", "changed"), ("k700", "changed"), ("k9", "removed"), ("new", "added")]
    assert len(table.differing_buckets(1, 4)) <= 5 and table.differing_buckets(2, 3) == [] and table.changes(2, 3).count() == 0
    assert sorted(r["count"] for r in table.tree().groupBy("level").count().collect()) == [1, 4, 64]
    assert table.changes(0, 1).count() == 800


def test_two_writers_leave_a_version_each(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, f"{tmp_path}/t", SCHEMA, buckets=4)
    table.merge(rows(spark, ["a"]))
    meet = threading.Barrier(2)
    described = VersionedTable._described

    def slow(self, name):  # both have written their rows before either publishes
        found = described(self, name)
        try:
            meet.wait(60)
        except threading.BrokenBarrierError:
            pass
        meet.reset() if meet.broken else None
        return found

    monkeypatch.setattr(VersionedTable, "_described", slow)
    threads = [threading.Thread(target=lambda k=k: (table.merge(rows(spark, [k], 1)), meet.abort())) for k in ("b", "c")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert table.latest() == 3 and held(table) == {"a": 0, "b": 1, "c": 1}


def test_a_writer_that_dies_leaves_the_last_version_whole(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, f"{tmp_path}/t", SCHEMA, buckets=4)
    table.merge(rows(spark, ["a"]))
    with monkeypatch.context() as broken:
        broken.setattr(VersionedTable, "_published", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            table.merge(rows(spark, ["a", "b"], 1))
    assert table.latest() == 1 and held(table) == {"a": 0}
    table.merge(rows(spark, ["b"], 1))
    assert held(table) == {"a": 0, "b": 1}
    with pytest.raises(Conflict):
        table._published(2, table.manifest(), table.manifest().limit(0))
    assert versions.FANOUT == 16


def test_enrichment_at_read_follows_the_roster(spark, tmp_path):
    from ledgerlark.sources.readers import TRADE_SCHEMA

    table = VersionedTable(spark, f"{tmp_path}/t", TRADE_SCHEMA, buckets=4)
    one = spark.range(1).selectExpr("'house:1:0' AS id", "'house' AS chamber", "'Ann Lee' AS member", *(f"CAST(NULL AS {t}) AS {c}" for c, t in (x.split() for x in TRADE_SCHEMA.split(", ")[3:])))
    table.merge(one)
    roster = lambda party: spark.createDataFrame([(0, "Ann Lee", "house", party, "QQ", None, [])], "position int, name string, chamber string, party string, state string, district string, aliases array<string>")
    assert [table.enriched(roster(p)).first().party for p in "DR"] == ["D", "R"] and table.latest() == 1


def test_no_task_holds_more_than_a_file_or_a_slice_of_the_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FILE_ROWS", 50, raising=False)
    table = VersionedTable(spark, f"{tmp_path}/t", SCHEMA, buckets=4, most_files=4)
    keys = [f"k{k}" for k in range(2000)]
    table.merge(rows(spark, keys))
    files = table.manifest().collect()
    assert max(f.n for f in files) <= 50 and sum(f.n for f in files) == 2000
    for bucket in range(4):  # files of a bucket have ranges of their own
        ranges = sorted((f.low, f.high) for f in files if f.bucket == bucket)
        assert len(ranges) > 4 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    told = table.merge(rows(spark, ["k7"], 1))  # many files make no bucket crowded, many small ones do
    assert told["rewritten"] <= 3 and told["rows_read"] <= 150
    table.merge(rows(spark, keys[::2], 2))  # several slices of keys for each bucket
    table.delete(lambda df: df.filter("n = 0 AND id < 'k5'"))
    assert held(table) == {k: 2 if i % 2 == 0 else int(k == "k7") for i, k in enumerate(keys) if i % 2 == 0 or k == "k7" or k >= "k5"}
    assert max(f.n for f in table.manifest().collect()) <= 50


def test_files_are_described_side_by_side(spark, tmp_path, monkeypatch):
    from pyspark import TaskContext

    table = VersionedTable(spark, f"{tmp_path}/t", SCHEMA, buckets=32)
    monkeypatch.setattr(VersionedTable, "_described", lambda self, name, plain=VersionedTable._described: plain(self, name).repartition(4).mapInArrow(lambda bs: ((tmp_path / f"task{TaskContext.get().partitionId()}").touch() or b for b in bs), versions.FILE))
    table.merge(rows(spark, [f"k{k}" for k in range(2000)]))
    assert len(list(tmp_path.glob("task*"))) > 1
