import threading
from pathlib import Path

from ledgerlark.operators import scratch
from ledgerlark.operators.scratch import mark, numbered, owned, release, saved


def test_queries_side_by_side_keep_their_tables(spark):
    kept, ready, done = {}, threading.Event(), threading.Event()

    def other():
        began = mark()
        kept["other"] = saved(spark.range(5), "other")
        ready.set()
        done.wait(60)
        kept["n"] = kept["other"].count()
        release(spark, began)

    began = mark()
    thread = threading.Thread(target=other)
    thread.start()
    assert ready.wait(60)
    mine = saved(spark.range(3), "mine")
    gone = saved(spark.range(3), "gone")
    release(spark, began, (mine,))
    done.set()
    thread.join()
    there = lambda df: Path(df._saved_at.removeprefix("file:")).exists()
    assert kept["n"] == 5 and mine.count() == 3
    assert (there(mine), there(gone), there(kept["other"])) == (True, False, False)
    release(spark, began)
    assert not there(mine)


def test_paths_of_its_own_are_swept_in_the_end(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_left", set())
    path = owned(spark, "folder")
    spark.range(2).write.parquet(path)
    assert scratch._left == {path}
    scratch._sweep(spark)
    assert not Path(path.removeprefix("file:")).exists() and not scratch._left


def test_rows_are_numbered_without_gaps(spark):
    assert sorted(r.n for r in numbered(spark.range(100, numPartitions=7), "n").collect()) == list(range(100))
