"""As-of joins of fast streams with slowly updated tables.

In all of them rows without key or time find nothing, updates without key, time or value are none, and of updates of one
time the largest value counts. Columns of ``left`` may have any names; one called like the value is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clock import unused

#: Updates of at most so many rows (24 bytes each, 10 MB) are sent to every task by ``asof_join_small``; more are joined
#: by bucket.
BROADCAST_UPDATES = 400_000


def _updates(right: DataFrame, key: str, value: str, name: str) -> DataFrame:
    known = right.filter(F.col(key).isNotNull() & F.col("ts").isNotNull() & F.col(value).isNotNull())
    return known.groupBy(key, "ts").agg(F.max(value).alias(name))


def asof_join(
    left: DataFrame, right: DataFrame, key: str, value: str, closed: str = "left", default=None, bucket: int | None = None
) -> DataFrame:
    """``left`` with the key's latest ``value``: strictly before its time (``closed="left"``), or at it too
    (``"right"``); ``default`` where there is none.

    With ``bucket`` a key's rows are dealt by time as well, and each bucket starts from the last value of the buckets
    before it, so that one key may carry all traffic.
    """
    kept = [c for c in left.columns if c != value]
    b, r, own, v, end = unused([*left.columns, key, value], "_b", "_r", "_own", "_v", "_end")
    rank = 1 if closed == "left" else -1
    part = F.floor(F.col("ts") / F.lit(bucket)) if bucket else F.lit(0)
    updates = _updates(right, key, value, v).withColumns({b: part, r: F.lit(rank)})
    rows = left.select(*kept).withColumns({b: part, r: F.lit(0), own: F.lit(True)})
    both = rows.unionByName(updates, allowMissingColumns=True)
    latest = F.last(v, ignorenulls=True).over(Window.partitionBy(key, b).orderBy("ts", r))
    found = both.withColumn(v, latest).filter(own)
    if bucket:
        ends = updates.groupBy(key, b).agg(F.max_by(v, "ts").alias(end))
        ends = ends.unionByName(rows.select(key, b).distinct(), allowMissingColumns=True)
        ends = ends.groupBy(key, b).agg(F.max(end).alias(end))
        earlier = Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(key, b, F.last(end, ignorenulls=True).over(earlier).alias(end))
        found = found.join(carried, [key, b], "left").withColumn(v, F.coalesce(v, end))
    out = F.col(v) if default is None else F.coalesce(v, F.lit(default))
    return found.select(*kept, out.alias(value))


def asof_join_small(left: DataFrame, right: DataFrame, key: str, value: str, closed: str = "left", bucket: int = 3_600_000) -> DataFrame:
    """``asof_join`` of whole-number keys and values for few updates: they are sent to every task and ``left`` stays where
    it is. More than BROADCAST_UPDATES of them are joined by ``bucket`` instead, with equal results."""
    longs = [F.col(c).cast("long").alias(n) for c, n in ((key, "k"), ("ts", "t"), ("v", "v"))]
    updates = _updates(right, key, value, "v").select(*longs)
    if updates.count() > BROADCAST_UPDATES:
        return asof_join(left, right, key, value, closed, bucket=bucket).withColumn(value, F.col(value).cast("long"))
    found = updates.toArrow()
    k, t, v = (found.column(c).to_numpy() for c in ("k", "t", "v"))
    order = np.lexsort((t, k))
    k, t, v = k[order], t[order], v[order]
    keys, times = np.unique(k), np.unique(t)
    # one number a (key, time), in their order
    place = np.searchsorted(keys, k) * (len(times) + 1) + np.searchsorted(times, t) + 1
    shared = left.sparkSession.sparkContext.broadcast((keys, times, place.astype(np.int64), v))
    side = "left" if closed == "left" else "right"

    @F.arrow_udf("long")
    def find(k: pa.Array, t: pa.Array) -> pa.Array:
        keys, times, place, values = shared.value
        known = np.asarray(k.is_valid()) & np.asarray(t.is_valid())
        k, t = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in (k, t))
        at = np.searchsorted(keys, k)
        known &= np.append(keys, 0)[at] == k
        base = at * (len(times) + 1)
        last = np.searchsorted(place, base + np.searchsorted(times, t, side), "right") - 1
        known &= (at < len(keys)) & (last >= 0) & (np.append(place, 0)[last] > base)
        return pa.array(np.append(values, 0)[last], pa.int64(), mask=~known)

    kept = [c for c in left.columns if c != value]
    return left.select(*kept, find(F.col(key).cast("long"), F.col("ts").cast("long")).alias(value))


def lookup(gets: DataFrame, updates: DataFrame, key: str, value: str, default=None) -> DataFrame:
    """Reads of the table as it was before each get."""
    return asof_join(gets, updates, key, value, "left", default)


def forward_asof_join(views: DataFrame, updates: DataFrame, key: str, value: str, bucket: int | None = None) -> DataFrame:
    """Each view with the key's next updates at or after it (all of one time); views after the last go.

    With ``bucket`` a key's rows are dealt by time as well, and each bucket ends with the first update of those after."""
    kept = [c for c in views.columns if c not in (value, "update_ts")]
    b, r, own, first = unused([*views.columns, key, value], "_b", "_r", "_own", "_first")
    part = F.floor(F.col("ts") / F.lit(bucket)) if bucket else F.lit(0)
    known = updates.filter(F.col(key).isNotNull() & F.col("ts").isNotNull())
    times = known.select(key, "ts").distinct().withColumns({b: part, r: F.lit(1), "update_ts": F.col("ts")})
    rows = views.select(*kept).filter(F.col(key).isNotNull() & F.col("ts").isNotNull())
    rows = rows.withColumns({b: part, r: F.lit(0), own: F.lit(True)})
    both = rows.unionByName(times, allowMissingColumns=True)
    order = Window.partitionBy(key, b).orderBy(F.col("ts").desc(), F.col(r).desc())
    nexts = both.withColumn("update_ts", F.last("update_ts", ignorenulls=True).over(order)).filter(own)
    if bucket:
        firsts = times.groupBy(key, b).agg(F.min("ts").alias(first))
        firsts = firsts.unionByName(rows.select(key, b).distinct(), allowMissingColumns=True)
        firsts = firsts.groupBy(key, b).agg(F.min(first).alias(first))
        # from the last bucket to the first, so that the frame only grows
        later = Window.partitionBy(key).orderBy(F.col(b).desc()).rowsBetween(Window.unboundedPreceding, -1)
        carried = firsts.select(key, b, F.last(first, ignorenulls=True).over(later).alias(first))
        nexts = nexts.join(carried, [key, b], "left").withColumn("update_ts", F.coalesce("update_ts", first))
    right = known.select(key, F.col("ts").alias("update_ts"), value)
    return nexts.filter("update_ts is not null").select(*kept, "update_ts").join(right, [key, "update_ts"])


def join_by_timestamp(a: DataFrame, b: DataFrame, *also: str) -> DataFrame:
    """All pairs of equal time (and equal ``also`` columns)."""
    return a.join(b, ["ts", *also])


def current_table(updates: DataFrame, key: str, value: str) -> DataFrame:
    """The latest value of each key; of one time the largest."""
    return updates.groupBy(key).agg(F.max_by(value, F.struct("ts", value)).alias(value), F.max("ts").alias("ts"))


def changelog(updates: DataFrame, key: str, value: str) -> DataFrame:
    """The update echo."""
    return updates.select(key, "ts", value)


def relevant_updates(updates: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Updates of keys that occur in ``keys``."""
    return updates.join(keys.select(key).distinct(), key, "left_semi")
