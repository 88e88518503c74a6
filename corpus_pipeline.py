"""From raw documents to packed token sequences: quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and all that the stage before it kept. The runner writes
each result as Parquet and gives the next stage the table it reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import documents, mark, release, saved
from ledgerlark.llm.encoder import vocabulary_path
from ledgerlark.llm.near_dedup import unique_documents
from ledgerlark.llm.packing import pack
from ledgerlark.llm.pii import mask_pii
from ledgerlark.llm.quality import clean_documents


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not mostly common lines; their common lines are gone.

    Null and empty texts fail the base rules and go; repeated rows and null doc_ids are judged
    like others and stay; an empty table gives none. A null source is the host "".
    """
    return clean_documents(docs)


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of near-duplicates (five words, 80 per cent).

    Rows with a null doc_id and documents without words stay; so do repeated rows of a kept
    text. Rows of one doc_id with different texts are judged each by its own. An empty table gives none.
    """
    return unique_documents(docs)


def pii(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null, empty and repeated rows stay as they are."""
    return mask_pii(docs)


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens, with their ids; a null or empty text is its end id alone, each repeated row is packed. Workers that run the other stages too remember fewer words, and forget them when a task ends."""
    return pack(docs, vocabulary_path(), remember=250_000, forget=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: MinHash and subset sums have no SQL form; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; what a stage has read goes once the next one's rows are written."""
    docs, began = documents(spark, sf_dir), mark()
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, began, (docs,))
    return STAGES[-1][1](spark, docs, sf_dir).withColumn("ids_crc32", F.crc32("ids"))
