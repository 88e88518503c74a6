import gc

import corpus_pipeline
from ledgerlark.llm.common import trimmed


def test_packing_leaves_no_words_in_the_workers(spark):
    docs = spark.createDataFrame([(k, f"word{k} and others") for k in range(8)], "doc_id long, text string").repartition(4)
    assert corpus_pipeline.packing(spark, docs, "").count() == 8

    def left(batches):
        import pyarrow as pa

        for batch in batches:
            found = [o for o in gc.get_objects() if type(o).__name__ == "WordEncoder" and o.remember == 250_000]
            yield pa.RecordBatch.from_arrays([pa.array([len(found)] * batch.num_rows, pa.int64())], names=["n"])

    assert {r.n for r in spark.range(64).repartition(16).mapInArrow(left, "n long").collect()} == {0}


def test_trimmed_gives_the_same_batches():
    assert list(trimmed(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3]
