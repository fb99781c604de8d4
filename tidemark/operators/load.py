"""Load summaries at four levels, and predictions from them.

Rows have house, household, plug, ts and val. Slices end at markers, ``(previous, marker]``. Levels are told by null
keys: all three null is everything, house alone a house, and so on. A row counts for the hour of day of its slice's
previous marker (hour 0 of the first slice's day start where there is none).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .clock import Markers, assign_marker, hour_of_day, marker_numbers, settled

LEVELS = ["house", "household", "plug"]
#: Rows that one task groups, when every key gets a row a slice.
GROUP_ROWS = 500_000


def _hour(previous: Column, unit: str) -> Column:
    return F.coalesce(hour_of_day(previous, unit), F.lit(0))


def _finest(load: DataFrame, slices: DataFrame, unit: str) -> DataFrame:
    placed = assign_marker(load, slices, closed="right").filter("marker is not null")
    hour = _hour(F.col("previous"), unit).alias("hour")
    return placed.groupBy("marker", hour, *LEVELS).agg(F.sum("val").alias("total"), F.count("*").alias("n"))


def _levels(fine: DataFrame, *keep: str) -> DataFrame:
    """The finest sums rolled up to all four levels: each level from the finest, which is the last one (a marker has one
    hour) and small already."""
    sums = [F.sum("total").alias("total"), F.sum("n").alias("n")]
    frames = []
    for depth in range(len(LEVELS) + 1):
        keys = LEVELS[:depth]
        level = fine.groupBy(*keep, *keys).agg(*sums) if depth < len(LEVELS) else fine
        for c in LEVELS[depth:]:
            level = level.withColumn(c, F.lit(None).cast(fine.schema[c].dataType))
        frames.append(level.select(*keep, *LEVELS, "total", "n"))
    return reduce(DataFrame.unionByName, frames)


def load_summaries(load: DataFrame, slices: DataFrame, unit: str = "ms") -> DataFrame:
    """(marker, house, household, plug, total, n) per slice; keys stay with zeros from the slice they first occur in."""
    slices = settled(slices)
    return _summaries(written(_finest(load, slices, unit), "load"), slices)


def _summaries(fine: DataFrame, slices: Markers) -> DataFrame:
    sums = written(_levels(fine, "marker"), "load-sums")
    # null keys name levels, so the spine meets the sums in a union, which takes null as a key
    seen = written(sums.groupBy(*LEVELS).agg(F.min("marker").alias("since")), "load-keys")
    numbers = marker_numbers(slices)
    if slices.known is not None:  # most keys begin with the first slice: no shuffle by it
        numbers = F.broadcast(numbers)
    many = seen.count() * slices.times.count() + sums.count()
    first = seen.join(numbers.withColumnRenamed("marker", "since"), "since").repartition(max(1, many // GROUP_ROWS), *LEVELS)
    spine = first.select(*LEVELS, F.explode(F.sequence("number", "markers")).alias("number"))
    spine = spine.join(numbers.drop("markers"), "number").drop("number")
    # a key has few sums and many zeros: rows are dealt as they are, in parts of about GROUP_ROWS, and grouped there
    rows = sums.unionByName(spine, allowMissingColumns=True).repartition(max(1, many // GROUP_ROWS), "marker", *LEVELS)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.groupBy("marker", *LEVELS).agg(zero("total"), zero("n"))


def load_by_hour(load: DataFrame, slices: DataFrame, unit: str = "ms") -> DataFrame:
    """(marker, hour, house, household, plug, total, n): all slices so far, per hour of day; a row where an hour's sums
    change."""
    return _by_hour(_finest(load, slices, unit))


def _by_hour(fine: DataFrame) -> DataFrame:
    sums = _levels(fine, "marker", "hour")
    so_far = Window.partitionBy("hour", *LEVELS).orderBy("marker").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("marker", "hour", *LEVELS, F.sum("total").over(so_far).alias("total"), F.sum("n").over(so_far).alias("n"))


def average(total: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(total / n)


def load_averages(load: DataFrame, slices: DataFrame, unit: str = "ms") -> DataFrame:
    """(marker, house, household, plug, slice_avg, hour_avg): the slice's average, and the average so far of the hour
    of day of this marker; 0 where nothing was counted."""
    slices = settled(slices)
    fine = written(_finest(load, slices, unit), "load")
    now = _summaries(fine, slices).withColumn("hour", hour_of_day(F.col("marker"), unit))
    past = _by_hour(fine).withColumns({"_t": F.col("total"), "_n": F.col("n")}).drop("total", "n")
    both = now.withColumn("_now", F.lit(True)).unionByName(past, allowMissingColumns=True)
    order = Window.partitionBy("hour", *LEVELS).orderBy("marker", F.col("_now").asc_nulls_first())
    t, n = (F.last(c, ignorenulls=True).over(order) for c in ("_t", "_n"))
    rows = both.withColumns({"_ht": t, "_hn": n}).filter("_now")
    hour = F.coalesce(average(F.col("_ht"), F.col("_hn")), F.lit(0.0))
    return rows.select("marker", *LEVELS, average(F.col("total"), F.col("n")).alias("slice_avg"), hour.alias("hour_avg"))


def _predict(averages: DataFrame, depths: list[int], weights: list[float]) -> DataFrame:
    """Dot product of both averages at each depth of ``depths`` (last: the predicted one) with ``weights``. The averages
    are written once and read once a level."""
    averages = written(averages, "load-averages")

    def level(depth: int) -> DataFrame:
        own = averages
        for i, k in enumerate(LEVELS):
            own = own.filter(F.col(k).isNotNull() if i < depth else F.col(k).isNull())
        return own.select("marker", *LEVELS[:depth], F.col("slice_avg").alias(f"s{depth}"), F.col("hour_avg").alias(f"h{depth}"))

    out = level(depths[-1])
    for d in depths[:-1]:
        out = out.join(level(d), ["marker", *LEVELS[:d]])
    terms = [F.col(f"{x}{d}") for d in depths for x in "sh"]
    value = reduce(lambda a, b: a + b, [t * F.lit(float(w)) for t, w in zip(terms, weights, strict=True)])
    return out.select("marker", *LEVELS[: depths[-1]], value.alias("prediction"))


def predict_house(load: DataFrame, slices: DataFrame, weights: list[float] | None = None, unit: str = "ms") -> DataFrame:
    return _predict(load_averages(load, slices, unit), [0, 1], weights or [1 / 4] * 4)


def predict_plug(load: DataFrame, slices: DataFrame, weights: list[float] | None = None, unit: str = "ms") -> DataFrame:
    return _predict(load_averages(load, slices, unit), [0, 1, 2, 3], weights or [1 / 8] * 8)


def merge_summaries(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Partial summaries of the same keys, added; null keys are keys."""
    keys = keys or ("marker", *LEVELS)
    return a.unionByName(b).groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
