"""Removal of repeated word windows by level-wise doubling (operator 3).

Levels are window lengths that double up to the target: 7, 13, 25 and 50 words for 50. At each level below the target
a window of the target length is looked at through the leftmost minimum of the hashes of its windows of that level, so
that equal windows show equal parts, and few positions are kept. Windows whose part occurs in one document alone end
there; only those that repeat go to the next level, of twice the length, until the target decides or none is left. At
the last level below the target, runs of windows that several documents share as a whole are settled once, by the run's
own hash, and only the first document of each run is looked at window by window, where its part has other runs too.

Counts of a level are written before they meet its rows again, so that the join of a part that very many documents
share can be split.

Defined results: null or empty text has no words; a null ``doc_id`` neither removes nor is removed from;
repeated rows of one ``doc_id`` share one fate, since only a smaller ``doc_id`` removes; texts under one id are judged
one by one; a text of any length is one row of a batch; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Scratch, small_batches

_KEY = ["kid", "tid"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key that is never null: the id with a hash of the text, which tells apart texts under one
    id. Both text joins of a plan then read one shuffle of the texts."""
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return small_batches(docs).select(
        doc_id.alias("doc_id"), text.alias("text"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("kid"), F.hash(text).alias("tid")
    )


def levels(length: int) -> list[int]:
    """Window lengths that double, rounded up, to ``length``: one below it at least."""
    out = [length]
    while out[0] > 7 or len(out) < 2:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _parts(width: int, length: int, spanned: bool):
    """The ``width``-word part of each target-length window (with ``spanned`` of those in the spans only), one row for a
    run of windows that show the same part, with a hash of the run's words."""

    def one(part: pa.RecordBatch) -> pa.RecordBatch | None:
        w = T.words(part.column("text"))
        if spanned:
            row, lo, hi = _spans(part)
            at = np.unique(T.ranges(w.first[row] + lo, hi - lo + 1))
        else:
            at = w.windows(length)
        if not len(at):
            return None
        sums, n = T.Prefix(w.hash), len(w.hash)
        every = np.arange(n - width + 1)
        chosen = T.leftmost_minimum(T.mix(sums.of(every, every + width)), length - width + 1)[at]
        doc = np.searchsorted(w.first, at, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(at)) - 1
        lo, hi, q, doc = at[begin], at[last], chosen[begin], doc[begin]
        zero = w.first[doc]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(T.mix(sums.of(q, q + width)).view(np.int64)),
                pa.array(T.mix(sums.of(lo, hi + length), 7).view(np.int64)),
                part.column("kid").take(pa.array(doc)),
                part.column("tid").take(pa.array(doc)),
                pa.array((lo - zero).astype(np.int32)),
                pa.array((hi - zero).astype(np.int32)),
            ],
            ["part", "run", "kid", "tid", "lo", "hi"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                if (out := one(part)) is not None:
                    yield out

    return run, "part long, run long, kid long, tid int, lo int, hi int"


def _spans(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, lo and hi of the ``spans`` list column."""
    column = part.column("spans")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    return (
        np.repeat(np.arange(part.num_rows), counts),
        flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64),
        flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64),
    )


def _full_windows(length: int):
    """Target-length windows that start in each document's spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                w = T.words(part.column("text"))
                sums = T.Prefix(w.hash)
                other = T.Prefix(T.mix(w.hash, 0x5851F42D4C957F2D))
                row, lo, hi = _spans(part)
                at = T.ranges(w.first[row] + lo, hi - lo + 1)
                row = np.repeat(row, hi - lo + 1)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(T.mix(sums.of(at, at + length)).view(np.int64)),
                        pa.array((T.mix(other.of(at, at + length)) >> np.uint64(33)).astype(np.int32)),
                        part.column("kid").take(take),
                        part.column("tid").take(take),
                        pa.array((at - w.first[row]).astype(np.int32)),
                    ],
                    ["window", "check", "kid", "tid", "at"],
                )

    return run, "window long, check int, kid long, tid int, at int"


def _cut(length: int):
    """Drops the words below flagged windows; digests of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                w = T.words(part.column("text"))
                row, lo, hi = _spans(part)
                change = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(change, w.first[row] + lo, 1)
                np.add.at(change, w.first[row] + hi + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                texts, data = [], w.data.tobytes()
                for i in range(part.num_rows):
                    a, b = w.first[i], w.first[i + 1]
                    keep = np.flatnonzero(~gone[a:b]) + a
                    s, e = w.start[keep].tolist(), w.end[keep].tolist()
                    texts.append(b" ".join([data[x:y] for x, y in zip(s, e, strict=True)]))
                before = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(w.first)),
                        pa.array(np.diff(before[w.first])),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                        pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _listed(spans: DataFrame) -> DataFrame:
    return spans.groupBy(*_KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # of one text, however often it comes


def repeated_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """Spans ``[lo, hi]`` of window starts whose window also starts in a document of smaller doc_id.

    ``docs`` comes from ``_keyed``; returns kid, tid, lo, hi.
    """
    tables = Scratch(docs.sparkSession, "op3")
    known = docs.filter(F.col("doc_id").isNotNull())
    least, most = F.min("kid").alias("a"), F.max("kid").alias("b")
    alive = None
    for width in levels(length)[:-1]:
        texts = known if alive is None else known.join(_listed(alive).hint("shuffle_hash"), _KEY)
        rows = tables.table("rows", texts.mapInArrow(*_parts(width, length, alive is not None)))
        counts = rows.groupBy("part").agg(least, most, F.min("run").alias("r"), F.max("run").alias("s"))
        counts = counts.filter("a < b").select("part", (F.col("r") < F.col("s")).alias("varies"))
        counts = tables.table("counts", counts)
        alive = tables.table("alive", rows.join(counts, "part").drop("part"))
        tables.drop("rows", "counts")
        tables.drop("alive", but_last=True)

    firsts = tables.table("firsts", alive.groupBy("run").agg(F.min("kid").alias("first_doc")))
    runs = tables.table("runs", alive.join(firsts, "run").drop("run"))
    tables.drop("alive", "firsts")
    leaders = _listed(runs.filter("varies and kid = first_doc").select(*_KEY, "lo", "hi").distinct())
    full = tables.table("full", known.join(leaders.hint("shuffle_hash"), _KEY).mapInArrow(*_full_windows(length)))
    first = tables.table("first", full.groupBy("window", "check").agg(least, most).filter("a < b").drop("b"))
    late = full.join(first, ["window", "check"]).filter("kid > a")
    whole = runs.filter("kid > first_doc").select(*_KEY, "lo", "hi")
    spans = whole.unionByName(late.select(*_KEY, F.col("at").alias("lo"), F.col("at").alias("hi")))
    spans = tables.table("spans", spans)
    tables.drop("runs", "full", "first")
    return spans


def remove_repeated_windows(docs: DataFrame, length: int = 50) -> DataFrame:
    """Each document without the words of windows that a smaller doc_id also has.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by one space), one row per
    input row. Windows are judged on the input, not on what is left.
    """
    docs = _keyed(docs)
    spans = _listed(repeated_spans(docs, length))
    return docs.join(spans.hint("shuffle_hash"), _KEY, "left").mapInArrow(*_cut(length))
