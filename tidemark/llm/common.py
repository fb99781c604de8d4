"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Scratch, shared_dir, written
from . import text as T

__all__ = ["Scratch", "partitions", "sent", "shared_dir", "small_batches", "table", "trim", "trimmed", "words_column", "written"]

#: Words are maximal runs of characters other than ASCII white space (Java and Python syntax alike).
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Rows of whole texts that go to a Python task at a time.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose texts go to Python tasks BATCH_ROWS at a time, from here on in the session.

    Spark's 10,000 whole texts fill the memory of both sides. The setting stays, since frames are run later than they
    are made; it never changes a result, and a smaller one is left alone."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return docs


def trim() -> None:
    """Gives memory that is free back to the system. Python processes outlive their tasks, and Arrow and the C library
    keep what was freed."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if give:
        give(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, whose process keeps no free memory and no powers of hashes when a task has ended: Spark keeps it for the
    tasks that come, and one long text makes the powers many."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            T.forget()
            trim()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a few numbers that are sent to every task at most (some 20 MB as a hash table).
SENT_ROWS = 400_000


def sent(rows: DataFrame, otherwise: str = "") -> DataFrame:
    """``rows``, a written table of a few numbers each, as the side of a join that goes to every task if they are
    SENT_ROWS or fewer; of more, both sides are shuffled (with the hint ``otherwise``)."""
    if rows.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        return F.broadcast(rows)
    return rows.hint(otherwise) if otherwise else rows


def words_column(text: F.Column | str) -> F.Column:
    """The words of a text as an array of strings; null text: no words."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")
