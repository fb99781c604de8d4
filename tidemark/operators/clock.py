"""Order, frontiers and assignment of events to markers.

Times are integers (any unit). ``closed="left"`` windows are ``[previous, marker)``: a marker comes before an event of
its own time; ``closed="right"`` windows are ``(previous, marker]``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Markers of at most so many distinct times (8 MB) are sent to every task; more meet the events by bucket.
BROADCAST_MARKERS = 1_000_000
#: Markers of a bucket, so that Spark's window keeps a usual one in memory, and the most buckets there are; the time each
#: begins with is sent to every task.
BUCKET_MARKERS, BUCKETS = 256, 4096

HOUR = {"ns": 3_600_000_000_000, "us": 3_600_000_000, "ms": 3_600_000, "s": 3_600}


def merge_ordered(*frames: DataFrame, order: tuple[str, ...] = ("ts", "tag", "source")) -> DataFrame:
    """Union of sources in one total order: time, then tag, then source."""
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f)
    return merged.orderBy(*order)


def frontier(events: DataFrame, source: str = "source", ts: str = "ts") -> DataFrame:
    """One row, ``frontier``: the least of the sources' latest times, heartbeats included."""
    return events.groupBy(source).agg(F.max(ts).alias("m")).agg(F.min("m").alias("frontier"))


def complete_until(events: DataFrame, source: str = "source", ts: str = "ts") -> DataFrame:
    """``events`` with ``released``: no source can still send anything earlier."""
    bound = frontier(events, source, ts)
    return events.join(F.broadcast(bound)).withColumn("released", F.col(ts) <= F.col("frontier")).drop("frontier")


@dataclass
class Markers:
    """Distinct marker times as a table of ts, and as a sorted array where there are at most BROADCAST_MARKERS."""

    times: DataFrame
    known: np.ndarray | None


def marker_times(markers: DataFrame | Markers, ts: str = "ts") -> DataFrame:
    if isinstance(markers, Markers):
        return markers.times
    return markers.select(F.col(ts).cast("long").alias("ts")).filter("ts is not null").distinct()


def settled(markers: DataFrame | Markers, ts: str = "ts") -> Markers:
    """The markers' times, found once for all parts of a job: few are collected (8 MB at most), more are written."""
    if isinstance(markers, Markers):
        return markers
    times, spark = marker_times(markers, ts), markers.sparkSession
    if markers.count() > BROADCAST_MARKERS:  # repeated ones among them
        times = written(times, "markers")
        if times.count() > BROADCAST_MARKERS:
            return Markers(times, None)
    known = np.sort(times.toArrow().column("ts").to_numpy())
    return Markers(spark.createDataFrame(pa.table({"ts": pa.array(known, pa.int64())})), known)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def assign_marker(
    events: DataFrame,
    markers: DataFrame | Markers,
    ts: str = "ts",
    closed: str = "left",
    bucket: str | None = None,
    carry: DataFrame | None = None,
) -> DataFrame:
    """``events`` with ``marker`` (the marker that closes the event's window, null after the last) and ``previous``
    (the marker before it, null in the first window; after the last marker, the last).

    Both are null for events without time. Columns of these names that ``events`` has already are replaced, all others
    are kept whatever their names. ``bucket`` names a column to add that is the same for all events of a window but the
    first: groups by it and by the marker need no other shuffle than the one that brought events and markers together.
    ``carry`` has columns marker and one more, which comes with ``previous``; a marker has one row at most."""
    found = settled(markers)
    if found.known is None:
        return _by_bucket(events, found.times, ts, closed, bucket, carry)
    placed = _by_search(events, found.known, ts, closed)
    if carry is not None:
        (key,) = unused(placed.columns, "_key")
        placed = placed.join(carry.withColumnRenamed("marker", key), F.col("previous") == F.col(key), "left").drop(key)
    return placed.withColumn(bucket, F.lit(0)) if bucket else placed


def _kept(events: DataFrame) -> list[str]:
    return [c for c in events.columns if c not in ("marker", "previous")]


def _by_search(events: DataFrame, times: np.ndarray, ts: str, closed: str) -> DataFrame:
    shared = events.sparkSession.sparkContext.broadcast(times)
    side = "right" if closed == "left" else "left"

    @F.arrow_udf("struct<marker:long,previous:long>")
    def place(t: pa.Array) -> pa.Array:
        known, lost = shared.value, np.asarray(t.is_null())
        at = np.searchsorted(known, t.fill_null(0).to_numpy(zero_copy_only=False), side)
        padded = np.append(known, 0)
        marker = pa.array(padded[at], pa.int64(), mask=lost | (at == len(known)))
        previous = pa.array(padded[np.maximum(at - 1, 0)], pa.int64(), mask=lost | (at == 0))
        return pa.StructArray.from_arrays([marker, previous], ["marker", "previous"])

    kept, (w,) = _kept(events), unused(events.columns, "_w")
    placed = events.withColumn(w, place(F.col(ts).cast("long")))
    return placed.select(*kept, f"{w}.marker", f"{w}.previous")


def bucket_starts(times: DataFrame) -> np.ndarray:
    """Times of some markers, the first and then about every BUCKET_MARKERS-th: about BUCKETS of them at most.

    Their places come from markers whose hash is small, a few for each bucket; they only decide who meets where."""
    n = times.count()
    many = min(BUCKETS, max(1, n // BUCKET_MARKERS))
    some = times.filter(F.pmod(F.xxhash64("ts"), F.lit(max(1, n // (16 * many)))) == 0)
    near = np.sort(some.toArrow().column("ts").to_numpy())
    near = near[np.arange(many) * len(near) // many] if len(near) else near
    # the first marker of each part, so that the least of all is one
    firsts = times.groupBy(_bucket(F.col("ts"), near, "right")).agg(F.min("ts").alias("ts"))
    return np.sort(firsts.toArrow().column("ts").to_numpy())


def _bucket(ts: Column, starts: np.ndarray, side: str) -> Column:
    """The number of bucket starts up to a time (``right``) or before it (``left``); 0 for null."""
    shared = starts

    @F.arrow_udf("int")
    def place(t: pa.Array) -> pa.Array:
        at = np.searchsorted(shared, t.fill_null(0).to_numpy(zero_copy_only=False), side)
        return pa.array(np.where(np.asarray(t.is_null()), 0, at), pa.int32())

    return place(ts.cast("long"))


def _start(bucket: Column, starts: np.ndarray) -> Column:
    """The time at which the bucket after this one begins, null after the last."""

    @F.arrow_udf("long")
    def look(b: pa.Array) -> pa.Array:
        at = b.to_numpy()
        return pa.array(np.append(starts, 0)[at], pa.int64(), mask=at == len(starts))

    return look(bucket)


def _by_bucket(
    events: DataFrame, times: DataFrame, ts: str, closed: str, bucket: str | None = None, carry: DataFrame | None = None
) -> DataFrame:
    """Markers and events meet in buckets that begin with markers, so that every event after the first marker finds
    the one before it in its own bucket. A marker row knows the marker after it, so events look back only, in one sort."""
    starts = bucket_starts(times)
    if not len(starts):
        return assign_marker(events, Markers(times, starts), ts, closed, bucket, carry)
    extra = [c for c in carry.columns if c != "marker"] if carry is not None else []
    b, t, r, m, own = unused(events.columns, "_b", "_t", "_r", "_m", "_own")
    marks = times.select(_bucket(F.col("ts"), starts, "right").alias(b), F.col("ts").alias(t))
    after = F.lead(t).over(Window.partitionBy(b).orderBy(t))
    next_start = _start(F.col(b), starts)
    marks = marks.select(b, t, F.lit(0 if closed == "left" else 2).alias(r), F.coalesce(after, next_start).alias(m))
    if extra:
        marks = marks.join(carry, F.col(t) == F.col("marker"), "left").drop("marker")
    marks = marks.select(b, t, r, F.struct(F.col(t).alias("p"), F.col(m).alias("m"), *extra).alias(m))
    kept = _kept(events)
    at = _bucket(F.col(ts), starts, "right" if closed == "left" else "left")
    # nothing is to be found before the first marker: those events are dealt out
    rows = events.withColumn(b, at).withColumns({t: F.col(ts).cast("long"), r: F.lit(1), own: F.lit(True)})
    rows = rows.withColumn(b, F.when(F.col(b) > 0, F.col(b)).otherwise(-F.pmod(F.hash(t, *kept[:1]), F.lit(BUCKETS))))
    rows = rows.select(*kept, b, t, r, own)
    both = rows.unionByName(marks, allowMissingColumns=True)
    back = Window.partitionBy(b).orderBy(t, r).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(m, F.last(m, ignorenulls=True).over(back)).filter(own)
    early = F.when((F.col(b) <= 0) & F.col(t).isNotNull(), F.lit(int(starts[0])))
    out = [F.coalesce(F.col(f"{m}.m"), early).alias("marker"), F.col(f"{m}.p").alias("previous")]
    out += [F.col(f"{m}.{c}") for c in extra]
    return found.select(*kept, *out, *([F.col(b).alias(bucket)] if bucket else []))


def reclock(events: DataFrame, clock: DataFrame | Markers, ts: str = "ts") -> DataFrame:
    """``events`` moved to the first clock tick at or after their time; those after the last tick go."""
    placed = assign_marker(events, clock, ts, "right").filter("marker is not null")
    return placed.withColumn(ts, F.col("marker")).drop("marker", "previous")


def hour_of_day(ts: Column, unit: str = "ms") -> Column:
    """Hour of the day of an epoch time, also before the epoch."""
    return F.floor(F.pmod(ts, F.lit(24 * HOUR[unit])) / F.lit(HOUR[unit])).cast("int")


def only_kind(events: DataFrame, kinds: list[str], column: str = "kind") -> DataFrame:
    return events.filter(F.col(column).isin(kinds))


def marker_line(markers: DataFrame | Markers, ts: str = "ts") -> DataFrame:
    """(marker, previous) of every distinct marker: one row a marker, ordered by the small table alone."""
    times = marker_times(markers, ts).withColumnRenamed("ts", "marker")
    return times.withColumn("previous", F.lag("marker").over(Window.orderBy("marker")))


def marker_numbers(markers: DataFrame | Markers, ts: str = "ts") -> DataFrame:
    """(marker, number from 1, markers in all) of every distinct marker: one row a marker, as in ``marker_line``."""
    times, line = marker_times(markers, ts).withColumnRenamed("ts", "marker"), Window.orderBy("marker")
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return times.select("marker", F.row_number().over(line).alias("number"), F.count("*").over(every).cast("int").alias("markers"))
