"""Repeated passages by a sparse suffix array (operator 2).

Suffixes are kept only where a minimiser of GRAM-word hashes lies, one in every passage of the target length at least.
They are sorted by their gram and the words after it, neighbours are compared, and each match is extended to the right
and to the left; a second order, by the gram and the words before it, finds the partners that agree best on the left.
What its neighbours prove for a suffix marks a span of its document with one partner; spans of one partner are joined
where they overlap by all but one word of a window. Neighbours meet every pair only where a gram has at most NEAR + 1 different
surroundings. Where it has more, every window of the target length that has the gram for its minimiser is grouped by
(gram, offset, words) as well, so no repeat depends on what sorts between two partners.

Equal surroundings are folded before sorting, so a passage of many copies is a few rows of the array. A match counts
only between different documents. Words are compared by 32-bit hashes beyond the gram.

Defined results: null and empty texts and null ids have no spans; repeated rows of one doc_id prove nothing for each
other and give the same rows once; among equal partners the smaller id counts; texts of any length are taken whole; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .common import Scratch, partitions, small_batches

GRAM = 16
#: Neighbours on either side that a suffix is compared with.
NEAR = 2
_KEY = ["doc_id", "tid"]


def _keyed(docs: DataFrame) -> DataFrame:
    rows = small_batches(docs).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("tid"))


def _suffixes(length: int):
    """The suffixes of the array: gram, document and word position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                w = T.words(part.column("text"))
                windows = w.windows(length)
                if not len(windows):
                    continue
                every = np.arange(len(w.hash) - GRAM + 1)
                h = T.mix(T.Prefix(w.hash).of(every, every + GRAM))
                at = np.unique(T.leftmost_minimum(h, length - GRAM + 1)[windows])
                doc = np.searchsorted(w.first, at, "right") - 1
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[at].view(np.int64)),
                        part.column("doc_id").take(take),
                        part.column("tid").take(take),
                        pa.array((at - w.first[doc]).astype(np.int32)),
                    ],
                    ["gram", "doc_id", "tid", "at"],
                )

    return run, "gram long, doc_id long, tid int, at int"


def _surroundings(length: int):
    """The words around each suffix's gram as 32-bit hashes, outwards; 0 where the document ends. ``least`` to ``most``
    are the gram's offsets in the windows that have it for their minimiser."""
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", 1 << 20):
                w = T.words(part.column("text"))
                column = part.column("at")
                counts = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = column.flatten()
                row = np.repeat(np.arange(part.num_rows), counts)
                gram = flat.field(0)
                at = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
                small = (w.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                begin, end = w.first[row], w.first[row + 1]
                steps = np.arange(reach)
                after = (begin + at + GRAM)[:, None] + steps
                before = (begin + at - 1)[:, None] - steps
                windows = w.windows(length)
                h = T.mix(T.Prefix(w.hash).of(every := np.arange(len(w.hash) - GRAM + 1), every + GRAM))
                chosen = T.leftmost_minimum(h, reach + 1)[windows]  # ascending
                most = begin + at - windows[np.searchsorted(chosen, begin + at, "left")]
                least = begin + at - windows[np.searchsorted(chosen, begin + at, "right") - 1]
                last = max(0, len(small) - 1)
                right = np.where(after < end[:, None], small[np.minimum(after, last)], 0).astype(">u4")
                left = np.where(before >= begin[:, None], small[np.maximum(before, 0)], 0).astype(">u4")
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        gram,
                        pa.array([left[i].tobytes() for i in range(len(at))], pa.binary()),
                        pa.array([right[i].tobytes() for i in range(len(at))], pa.binary()),
                        part.column("doc_id").take(take),
                        part.column("tid").take(take),
                        pa.array(at.astype(np.int32)),
                        pa.array(least.astype(np.int32)),
                        pa.array(most.astype(np.int32)),
                    ],
                    ["gram", "left", "right", "doc_id", "tid", "at", "least", "most"],
                )

    return run, "gram long, left binary, right binary, doc_id long, tid int, at int, least int, most int"


def _windows(length: int):
    """Every window of a suffix's gram at its offsets: the words left of the gram, ``lo``, and a key of gram, offset
    and words."""
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            gram, least, most = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "least", "most"))
            sums = []  # of the first words outwards, each hashed with its place
            for c, place in (("left", 0), ("right", reach)):
                w = np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u4").reshape(n, reach).astype(np.uint64)
                salt = np.arange(place + 1, place + reach + 1, dtype=np.uint64) << np.uint64(32)
                sums.append(np.zeros((n, reach + 1), np.uint64))
                np.cumsum(T.mix(w | salt), axis=1, out=sums[-1][:, 1:])
            count = (most - least + 1).astype(np.int64)
            row, lo = np.repeat(np.arange(n), count), T.ranges(least.astype(np.int64), count)
            key = T.mix(gram.view(np.uint64)[row] + T.mix(sums[0][row, lo] + sums[1][row, reach - lo] + lo.astype(np.uint64)))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("ctx").take(take), pa.array(key.view(np.int64)), pa.array(lo.astype(np.int32))]
                + [batch.column(c).take(take) for c in ("low", "high")],
                ["ctx", "key", "lo", "low", "high"],
            )

    return run, "ctx long, key long, lo int, low long, high long"


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common run of words from the gram outwards, row by row."""
    same = (x == y) & (x != 0)
    return np.where(same.all(1), x.shape[1], np.argmin(same, 1))


def _neighbours(length: int):
    """Spans that each suffix shares with its neighbours in sorted order. The first and last rows of a task's share of
    the array come out too (``edge``), for the comparison across tasks."""
    reach, near = length - GRAM, NEAR

    def compare(rows: dict[str, np.ndarray]) -> tuple[list, list, list, list]:
        n = len(rows["gram"])
        left, right = (np.frombuffer(b"".join(rows[c]), ">u4").reshape(n, reach) for c in ("left", "right"))
        out = ([], [], [], [])
        for step in range(1, near + 1):
            a, b = np.arange(max(0, n - step)), np.arange(step, max(n, step))
            ok = (rows["gram"][a] == rows["gram"][b]) & ((rows["low"][a] != rows["high"][b]) | (rows["high"][a] != rows["low"][b]))
            a, b = a[ok], b[ok]
            lo, ro = _common(left[a], left[b]), _common(right[a], right[b])
            ok = lo + GRAM + ro >= length
            for me, other in ((a[ok], b[ok]), (b[ok], a[ok])):
                partner = np.where(rows["low"][other] != rows["high"][me], rows["low"][other], rows["high"][other])
                for column, values in zip(out, (rows["ctx"][me], lo[ok], ro[ok], partner), strict=True):
                    column.append(values)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ctx", "lo", "ro", "other", "gram", "left", "right", "low", "high", "edge"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]

        def emit(columns: list, n: int) -> pa.RecordBatch:
            arrays = [pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names)

        def edges(rows: dict, pick: np.ndarray) -> pa.RecordBatch:
            bins = [[rows[c][i] for i in pick] for c in ("left", "right")]
            return emit([rows["ctx"][pick], None, None, None, rows["gram"][pick], *bins, rows["low"][pick], rows["high"][pick], [True] * len(pick)], len(pick))

        tail: dict | None = None
        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("ctx", "gram", "low", "high")}
            rows |= {c: batch.column(c).to_pylist() for c in ("left", "right")}
            if tail is None:
                yield edges(rows, np.arange(min(near, batch.num_rows)))
            else:
                rows = {c: np.concatenate([tail[c], rows[c]]) if isinstance(rows[c], np.ndarray) else tail[c] + rows[c] for c in rows}
            found = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in compare(rows)]
            if len(found[0]):
                yield emit([*found, None, None, None, None, None, [False] * len(found[0])], len(found[0]))
            tail = {c: v[-near:] for c, v in rows.items()}
        if tail is not None:
            yield edges(tail, np.arange(len(tail["ctx"])))

    schema = "ctx long, lo int, ro int, other long, gram long, left binary, right binary, low long, high long, edge boolean"
    return run, schema


def _proofs(tables: Scratch, array: DataFrame, order: list[str], length: int) -> DataFrame:
    """(ctx, lo, ro, other) from neighbours in one order of the array, across tasks as well."""
    columns = ["ctx", "gram", "left", "right", "low", "high"]
    spark = array.sparkSession
    ranged = array.select(*columns).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    found = tables.table("neighbours", ranged.mapInArrow(*_neighbours(length)))
    # two rows at either end of each task: a table of the number of tasks
    edges = found.filter("edge").select(*columns).distinct().coalesce(1).sortWithinPartitions(*order)
    across = edges.mapInArrow(*_neighbours(length)).filter("not edge")
    return found.filter("not edge").unionByName(across).select("ctx", "lo", "ro", "other")


def _crowded(tables: Scratch, array: DataFrame, length: int) -> DataFrame:
    """(ctx, lo, ro, other, high) from equal windows, for grams with more surroundings than neighbours settle."""
    grams = array.groupBy("gram").count().filter(F.col("count") > NEAR + 1).select("gram")
    rows = array.join(grams, "gram", "left_semi").select("ctx", "gram", "left", "right", "least", "most", "low", "high")
    windows = tables.table("windows", rows.mapInArrow(*_windows(length)))
    shared = windows.groupBy("key").agg(F.min("low").alias("other"), F.max("high").alias("high")).filter("other < high")
    shared = tables.table("shared", shared)
    met = windows.select("ctx", "key", "lo").join(shared, "key").select("ctx", "other", "high", "lo").distinct()
    # windows at consecutive offsets are one span
    per = Window.partitionBy("ctx", "other", "high").orderBy("lo")
    met = met.withColumn("run", F.col("lo") - F.row_number().over(per))
    spans = met.groupBy("ctx", "other", "high", "run").agg(F.max("lo").alias("lo"), (length - GRAM - F.min("lo")).alias("ro"))
    return spans.select("ctx", "lo", "ro", "other", "high")


def repeated_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, other_doc_id): passages of at least ``length`` words, end exclusive, whose
    windows of ``length`` words all occur in other_doc_id too; that is the smallest document that a comparison met.

    A document has one row for each such partner and stretch, so passages of different partners may overlap."""
    tables = Scratch(docs.sparkSession, "op2")
    docs = _keyed(docs)
    suffixes = tables.table("suffixes", docs.mapInArrow(*_suffixes(length)))
    twice = suffixes.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("gram")
    twice = tables.table("twice", twice)  # written, so that the join can be split at a gram that very many documents have
    kept = suffixes.join(twice, "gram")
    places = kept.groupBy(*_KEY).agg(F.collect_set(F.struct("gram", "at")).alias("at"))  # of one text, however often it comes
    around = docs.join(places.hint("shuffle_hash"), _KEY).mapInArrow(*_surroundings(length))
    around = tables.table("around", around.withColumn("ctx", F.xxhash64("gram", "left", "right")))
    tables.drop("suffixes", "twice")
    array = around.groupBy("ctx").agg(
        F.first("gram").alias("gram"), F.first("left").alias("left"), F.first("right").alias("right"),
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("least").alias("least"), F.first("most").alias("most"),
    )
    array = tables.table("array", array)
    # surroundings that several documents share as a whole
    words = lambda c: sum((F.substring(c, 4 * i + 1, 4) != F.lit(bytes(4))).cast("int") for i in range(length - GRAM))
    own = array.filter("low < high").select("ctx", words("left").alias("lo"), words("right").alias("ro"), F.col("low").alias("other"), "high")
    own = own.filter(F.col("lo") + GRAM + F.col("ro") >= length)
    orders = (["gram", "right", "left"], ["gram", "left", "right"])
    proofs = _proofs(tables, array, orders[0], length).unionByName(_proofs(tables, array, orders[1], length))
    best = proofs.groupBy("ctx", "lo", "ro").agg(F.min("other").alias("other")).withColumn("high", F.col("other"))
    best = tables.table("best", best.unionByName(own).unionByName(_crowded(tables, array, length)))
    tables.drop("array", "neighbours", "windows")
    spans = around.select("ctx", *_KEY, "at").join(best, "ctx")
    partner = F.when(F.col("other") != F.col("doc_id"), F.col("other")).when(F.col("high") != F.col("doc_id"), F.col("high"))
    spans = spans.select(*_KEY, (F.col("at") - F.col("lo")).alias("s"), (F.col("at") + GRAM + F.col("ro")).alias("e"), partner.alias("o"))
    spans = tables.table("spans", spans.filter("o is not null").groupBy(*_KEY, "o", "s").agg(F.max("e").alias("e")))
    tables.drop("around", "best")
    return _joined(spans, length)


def _joined(spans: DataFrame, length: int) -> DataFrame:
    """Spans of a document and partner as one where every window of both together lies in one of them."""
    per = Window.partitionBy(*_KEY, "o").orderBy("s")
    reach = F.max("e").over(per.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("s") <= reach - length + 1, 0).otherwise(1)
    rows = spans.withColumn("begins", begins).withColumn("part", F.sum("begins").over(per))
    parts = rows.groupBy(*_KEY, "o", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return parts.select(
        "doc_id", F.col("s").alias("start_word"), F.col("e").alias("end_word"),
        (F.col("e") - F.col("s")).alias("n_words"), F.col("o").alias("other_doc_id"),
    )
