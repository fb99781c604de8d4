"""Keyed windows closed by markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clock import assign_marker, marker_line, settled


def dense(sums: DataFrame, markers: DataFrame, keys: DataFrame) -> DataFrame:
    """``sums`` (marker, key, ...) with a row for every marker and key, the null key too; ``keys`` times markers is the
    output's size."""
    spine = marker_line(markers).select("marker").crossJoin(keys).alias("a")
    same = F.col("a.marker") == F.col("b.marker")
    for k in keys.columns:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    rest = [c for c in sums.columns if c not in ("marker", *keys.columns)]
    return spine.join(sums.alias("b"), same, "left").select("a.*", *[f"b.{c}" for c in rest])


def tumbling_sum(
    events: DataFrame, markers: DataFrame, key: str, value: str = "val", closed: str = "left", every_key: bool = True
) -> DataFrame:
    """(marker, key, total): every key at every marker, zeros kept; without ``every_key`` only keys with events."""
    markers = settled(markers)
    placed = assign_marker(events, markers, closed=closed).filter("marker is not null")
    sums = placed.groupBy("marker", key).agg(F.sum(value).alias("total"))
    if not every_key:
        return sums
    return dense(sums, markers, events.select(key).distinct()).fillna(0, ["total"])


def sliding_sum(events: DataFrame, markers: DataFrame, key: str, panes: int = 3, value: str = "val") -> DataFrame:
    """(marker, key, total) over the last ``panes`` windows, from the marker that has so many on."""
    per = Window.partitionBy(key).orderBy("marker")
    tumbling = tumbling_sum(events, markers, key, value)
    total = F.sum("total").over(per.rowsBetween(1 - panes, 0)).alias("total")
    rows = tumbling.select("marker", key, total, F.row_number().over(per).alias("pane"))
    return rows.filter(F.col("pane") >= panes).drop("pane")


def distance_per_window(positions: DataFrame, markers: DataFrame, key: str, digits: int = 0, bucket: int | None = None) -> DataFrame:
    """(marker, key, distance): way between consecutive points, in the later point's window; the first point adds 0.
    Points of one time follow each other by x, then y.

    With ``bucket`` a key's points are dealt by time as well: the way from one block's last point to the next one's
    first comes from a table of one row a block, so that one key may have all points."""
    rows = positions.select(key, "ts", "x", "y", (F.floor(F.col("ts") / F.lit(bucket)) if bucket else F.lit(0)).alias("part"))
    per = Window.partitionBy(key, "part").orderBy("ts", "x", "y")
    way = lambda x, y: F.coalesce(F.hypot(x, y), F.lit(0.0)).alias("val")
    steps = rows.select(key, "ts", way(F.col("x") - F.lag("x").over(per), F.col("y") - F.lag("y").over(per)))
    if bucket:
        point = F.struct("ts", "x", "y")
        blocks = rows.groupBy(key, "part").agg(F.min(point).alias("first"), F.max(point).alias("last"))
        before = F.lag("last").over(Window.partitionBy(key).orderBy("part"))
        blocks = blocks.select(key, "first", before.alias("before"))
        between = way(F.col("first.x") - F.col("before.x"), F.col("first.y") - F.col("before.y"))
        steps = steps.unionByName(blocks.select(key, "first.ts", between))
    sums = tumbling_sum(steps, markers, key)
    return sums.select("marker", key, F.round("total", digits).alias("distance"))


def spike_alerts(pressure: DataFrame, temps: DataFrame, markers: DataFrame, spike: float = 100, heat: float = 50) -> DataFrame:
    """(marker, spike, heat) where the largest rise between consecutive pressures (the first rises from 0) and the
    least of the thermometers' highest temperatures both pass their bounds. Pressure windows are ``(previous, marker]``,
    temperature windows ``[previous, marker)``. Consecutive pressures cross windows: each window's first is measured
    from the last of the windows before it, which comes from the table of windows. Readings of one time follow each other
    from the lower to the higher."""
    markers = settled(markers)
    placed = assign_marker(pressure, markers, closed="right").filter("marker is not null")
    per = Window.partitionBy("marker").orderBy("ts", "pressure")
    rises = placed.withColumn("rise", F.col("pressure") - F.lag("pressure").over(per))
    windows = rises.groupBy("marker").agg(
        F.max("rise").alias("inner"), F.min_by("pressure", F.struct("ts", "pressure")).alias("first"), F.max_by("pressure", F.struct("ts", "pressure")).alias("last")
    )
    earlier = F.coalesce(F.lag("last").over(Window.orderBy("marker")), F.lit(0))  # one row a window
    spikes = windows.select("marker", F.greatest("inner", F.col("first") - earlier).alias("spike"))
    warm = assign_marker(temps, markers).filter("marker is not null")
    warm = warm.groupBy("marker", "thermo").agg(F.max("temp").alias("t")).groupBy("marker").agg(F.min("t").alias("heat"))
    return spikes.join(warm, "marker").filter((F.col("spike") >= spike) & (F.col("heat") >= heat))


def net_running_max(events: DataFrame, markers: DataFrame, chunks: int = 64) -> DataFrame:
    """(marker, high): the largest running total of ``delta`` in each period, 0 at least; totals start anew.

    A period is cut into ``chunks`` by time; sums and prefix maxima of chunks combine, so that a long one is no one
    task's work. Ties are ordered by ``seq``."""
    markers = settled(markers)
    placed = assign_marker(events, markers).filter("marker is not null")
    start = placed.filter("previous is null").agg(F.min("ts").alias("start"))  # the first period has no marker before it
    placed = placed.join(F.broadcast(start))
    begin = F.coalesce("previous", "start")
    # a double keeps the order of times, and nanoseconds times chunks within range
    share = (F.col("ts") - begin).cast("double") / (F.col("marker") - begin + 1)
    part = F.floor(share * chunks).alias("chunk")
    placed = placed.select("marker", part, "ts", "seq", "delta")
    run = F.sum("delta").over(Window.partitionBy("marker", "chunk").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    tops = placed.withColumn("run", run).groupBy("marker", "chunk").agg(F.max("run").alias("top"), F.sum("delta").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("marker").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    high = tops.withColumn("high", F.col("top") + F.coalesce(before, F.lit(0))).groupBy("marker").agg(F.max("high").alias("high"))
    full = marker_line(markers).select("marker").join(high, "marker", "left")
    return full.select("marker", F.greatest(F.coalesce("high", F.lit(0)), F.lit(0)).alias("high"))


def periodic(value: Column, size: int) -> Column:
    """The end of the periodic window that holds an integer time."""
    return (F.floor(value / F.lit(size)) + 1) * size
