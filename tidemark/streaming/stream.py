"""Structured Streaming versions of the marker-driven jobs.

Heartbeats become watermarks; several sources progress at the least of theirs (the session's default policy). Event
times are timestamps; windows are periodic where Spark's own window does, and closed by barriers where state must.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def watermarked(*sources: DataFrame, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """Union of streams, each with its own watermark; the union's is the least of them (the session's policy "min")."""
    marked = [s.withWatermark(ts, delay) for s in sources]
    out = marked[0]
    for m in marked[1:]:
        out = out.unionByName(m)
    return out


def stream_tumbling(events: DataFrame, size: str, *keys: str, total: Column | None = None) -> DataFrame:
    """(marker, keys, total): sums of windows of ``size``, sent when the watermark closes them."""
    total = F.sum("val") if total is None else total
    rows = events.groupBy(F.window("ts", size).alias("w"), *keys).agg(total.alias("total"))
    return rows.select(F.col("w.end").alias("marker"), *keys, "total")


def stream_sliding(events: DataFrame, size: str, slide: str, *keys: str) -> DataFrame:
    rows = events.groupBy(F.window("ts", size, slide).alias("w"), *keys).agg(F.sum("val").alias("total"))
    return rows.select(F.col("w.end").alias("marker"), *keys, "total")


def stream_load_summaries(load: DataFrame, size: str) -> DataFrame:
    """(marker, house, household, plug, total, n) at four levels in one aggregation: every row counts once a level."""
    levels = F.explode(
        F.array(
            F.struct(F.lit(None).cast("long").alias("house"), F.lit(None).cast("long").alias("household"), F.lit(None).cast("long").alias("plug")),
            F.struct("house", F.lit(None).cast("long").alias("household"), F.lit(None).cast("long").alias("plug")),
            F.struct("house", "household", F.lit(None).cast("long").alias("plug")),
            F.struct("house", "household", "plug"),
        )
    ).alias("level")
    rows = load.select("ts", "val", levels).groupBy(F.window("ts", size).alias("w"), "level")
    sums = rows.agg(F.sum("val").alias("total"), F.count("*").alias("n"))
    return sums.select(F.col("w.end").alias("marker"), "level.*", "total", "n")


def stream_fraud(trans: DataFrame, size: str, seconds: int, m: int = 1000) -> DataFrame:
    """Transactions whose val equals the previous window's sum modulo ``m``; windows without a predecessor model give
    nothing. The window aggregate meets the transactions of the window after it."""
    sums = trans.groupBy(F.window("ts", size).alias("w")).agg(F.sum("val").alias("model"))
    models = sums.select(F.window_time("w").alias("model_ts"), F.col("w.end").alias("start"), "model")
    begin = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / seconds) * seconds)
    rows = trans.select("*", begin.alias("window_start"))
    near = F.expr(f"ts >= model_ts and ts <= model_ts + interval {seconds + 1} seconds")
    hits = rows.join(models, (F.col("window_start") == F.col("start")) & near)
    return hits.filter(F.pmod("model", F.lit(m)) == F.pmod("val", F.lit(m))).select(*trans.columns)


class _Held:
    """One key's rows that wait for the watermark: whole numbers by name, the first the time in microseconds.

    They lie in a map, in chunks of at most ``rows`` that follow each other in time. A batch writes the chunks that it
    brings and reads those that the watermark has reached, however many others are held; which these are says an index
    of the chunks' first times."""

    def __init__(self, handle: StatefulProcessorHandle, names: list[str], rows: int):
        self.handle, self.names, self.most = handle, names, rows
        self.chunks = handle.getMapState("held", "chunk long", ", ".join(f"{n} array<bigint>" for n in names))
        self.index = handle.getValueState("chunks", "ids array<bigint>, firsts array<bigint>, made long")

    def _known(self) -> tuple[dict[int, int], int]:
        if not self.index.exists():
            return {}, 0
        ids, firsts, made = self.index.get()
        return dict(zip(ids, firsts, strict=True)), made

    def _write(self, chunk: int, columns: list[np.ndarray]) -> None:
        self.chunks.updateValue((chunk,), tuple(c.tolist() for c in columns))

    def add(self, batches: Iterator[pd.DataFrame]) -> None:
        parts = [[pdf[n].to_numpy(np.int64) for n in self.names] for pdf in batches if len(pdf)]
        if not parts:
            return
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order, (known, made) = np.argsort(columns[0], kind="stable"), self._known()
        for at in range(0, len(order), self.most):
            own = [c[order[at : at + self.most]] for c in columns]
            known[made] = int(own[0][0])
            self._write(made, own)
            made += 1
        self.index.update((list(known), list(known.values()), made))

    def take(self, upto_ms: int) -> list[np.ndarray]:
        """The rows before the watermark, in no order; they are held no more. Wakes when the next one is due."""
        upto, taken, (known, made) = upto_ms * 1000, [], self._known()
        reached = [chunk for chunk, first in known.items() if first < upto]
        for chunk in reached:
            columns = [np.array(c, np.int64) for c in self.chunks.getValue((chunk,))]
            due = columns[0] < upto
            taken.append([c[due] for c in columns])
            if due.all():
                self.chunks.removeKey((chunk,))
                del known[chunk]
            else:
                self._write(chunk, [c[~due] for c in columns])
                known[chunk] = int(columns[0][~due].min())
        if reached:
            self.index.update((list(known), list(known.values()), made))
        if known:
            self.handle.registerTimer(min(known.values()) // 1000 + 1)
        none = np.zeros(0, np.int64)
        return [np.concatenate([none, *parts]) for parts in zip(*taken, strict=True)] if taken else [none] * len(self.names)


class _Barriers(StatefulProcessor):
    """Holds a shard's values until the watermark passes, then adds them up between its copies of the barriers: what is
    left of them is one sum."""

    def __init__(self, chunk_rows: int):
        self.chunk_rows = chunk_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = _Held(handle, ["us", "val", "barrier"], self.chunk_rows)
        self.open = handle.getValueState("open", "total long")

    def _settled(self, upto_ms: int) -> pd.DataFrame:
        us, val, barrier = self.held.take(upto_ms)
        order = np.lexsort((1 - barrier, us))  # a barrier comes before a value of its own time
        us, val, mark = us[order], val[order], np.flatnonzero(barrier[order])
        total = self.open.get()[0] if self.open.exists() else 0
        sums = total + np.cumsum(np.where(barrier[order] == 1, 0, val))
        if len(us):
            self.open.update((int(sums[-1] - (sums[mark[-1]] if len(mark) else 0)),))
        return pd.DataFrame({"marker_us": us[mark], "total": np.diff(sums[mark], prepend=0)}).astype("int64")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.held.add(rows)
        yield self._settled(timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settled(timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_barrier_sum(values: DataFrame, barriers: DataFrame, shards: int = 8, chunk_rows: int = 4096) -> DataFrame:
    """(marker_us, total) per shard and barrier of streams with ts; sum them per marker_us for the total. Barriers are
    copied to every shard; values (ts, val) go to the shard of their hash, a null val counts as 0. ``chunk_rows``
    waiting rows are kept together."""
    us, one = F.unix_micros("ts").alias("us"), lambda x: F.lit(x).cast("long").alias("barrier")
    val = F.coalesce(F.col("val").cast("long"), F.lit(0)).alias("val")
    own = values.select("ts", us, val, one(0), F.pmod(F.xxhash64("ts", "val"), F.lit(shards)).alias("shard"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    marks = barriers.select("ts", us, F.lit(0).cast("long").alias("val"), one(1), copies)
    return own.unionByName(marks).groupBy("shard").transformWithStateInPandas(
        _Barriers(chunk_rows), "marker_us long, total long", "Append", "EventTime"
    )


class _Latest(StatefulProcessor):
    """Holds a bucket's rows until the watermark passes, then answers views with their key's latest value before them. The
    latest values of the bucket's keys lie in one state, so that a batch costs a bucket as much as it did a key."""

    def __init__(self, chunk_rows: int, forget_ms: int | None):
        self.chunk_rows, self.forget_ms = chunk_rows, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = _Held(handle, ["us", "val", "view", "id", "key"], self.chunk_rows)
        self.latest = handle.getValueState("latest", "keys array<bigint>, us array<bigint>, val array<bigint>")

    def _settled(self, upto_ms: int) -> pd.DataFrame:
        us, val, view, ids, key = self.held.take(upto_ms)
        known = [np.array(c, np.int64) for c in self.latest.get()] if self.latest.exists() else [np.zeros(0, np.int64)] * 3
        none = np.zeros(len(known[0]), np.int64)
        pairs = zip((*known, none, none, none), (key, us, val, view, ids, np.ones(len(us), np.int64)), strict=True)
        key, us, val, view, ids, new = (np.concatenate(p) for p in pairs)
        # of a key what is known comes first, a view before an update, the largest update of a time last
        order = np.lexsort((val, 1 - view, us, new, key))
        key, us, val, view, ids, new = (c[order] for c in (key, us, val, view, ids, new))
        at, first = np.arange(len(key)), np.append(True, key[1:] != key[:-1])[: len(key)]
        last = np.maximum.accumulate(np.where(view == 1, -1, at))
        found = last >= np.maximum.accumulate(np.where(first, at, 0))
        asked = np.flatnonzero(view)
        before = last[asked]
        known_then = found[asked]
        if self.forget_ms is not None:
            known_then &= us[asked] - us[before] < self.forget_ms * 1000
        answer = pd.array(val[before], "Int64")
        answer[~known_then] = pd.NA
        ends = np.flatnonzero(np.append(first[1:], True)[: len(key)])
        newest = last[ends][found[ends]]
        if self.forget_ms is not None:
            newest = newest[us[newest] + self.forget_ms * 1000 >= upto_ms * 1000]  # no view that is still to come would find the others
            if len(newest):
                self.handle.registerTimer(int(us[newest].min()) // 1000 + self.forget_ms + 1)
        if len(newest) == 0 and len(none):
            self.latest.clear()
        elif len(newest) != len(none) or new[newest].any():
            self.latest.update(tuple(c[newest].tolist() for c in (key, us, val)))
        return pd.DataFrame({"key": key[asked], "id": ids[asked], "us": us[asked], "val": answer})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.held.add(rows)
        yield self._settled(timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settled(timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_asof_join(
    views: DataFrame,
    updates: DataFrame,
    key: str,
    value: str,
    chunk_rows: int = 4096,
    forget_ms: int | None = None,
    buckets: int = 512,
) -> DataFrame:
    """(key, id, us, val) of views (ts, id) with the key's latest value strictly before them, null where there is none.
    Rows without key and updates without value are left out.

    With ``forget_ms`` a value that is so old when it is looked for is no answer, and keys without newer ones leave the
    state. ``chunk_rows`` waiting rows are kept together, and so are the latest values of the keys of one of ``buckets``."""
    us, k = F.unix_micros("ts").alias("us"), F.col(key).cast("long").alias("key")
    whole = lambda c, name: (F.lit(c) if isinstance(c, int) else F.col(c)).cast("long").alias(name)
    a = views.select("ts", us, k, whole(0, "val"), whole(1, "view"), whole("id", "id"))
    b = updates.filter(F.col(value).isNotNull()).select("ts", us, k, whole(value, "val"), whole(0, "view"), whole(0, "id"))
    rows = a.unionByName(b).filter("key is not null").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(
        _Latest(chunk_rows, forget_ms), "key long, id long, us long, val long", "Append", "EventTime"
    )


def late_rows(query) -> int:
    """Rows that a finished query dropped behind its watermark."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def drain(df: DataFrame, path: str, checkpoint: str):
    """Runs a stream over all that is there into Parquet; returns the finished query."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    query = query.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
