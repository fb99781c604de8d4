"""Latency and throughput of event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.prepare import with_row_index
from ..sources.shared import written
from .clock import unused

#: Log times of a stretch of ``throughput_series``.
SERIES_ROWS = 65_536


def event_latency(produced: DataFrame, consumed: DataFrame, key: str = "message") -> DataFrame:
    """(key, ts, latency, elapsed): from each message's last producer record to its last sink record, in
    milliseconds of nanosecond clocks; elapsed since the first sink record of the joined log."""
    last = lambda df, name: df.groupBy(key).agg(F.max_by("ts_ns", "ts_ns").alias(name))
    both = last(consumed, "ts").join(last(produced, "p"), key)
    start = both.agg(F.min("ts").alias("t0"))
    rows = both.join(F.broadcast(start))  # one row
    return rows.select(key, "ts", ((F.col("ts") - F.col("p")) / 1e6).alias("latency"), ((F.col("ts") - F.col("t0")) / 1e6).alias("elapsed"))


def unmatched(produced: DataFrame, consumed: DataFrame, key: str = "message") -> DataFrame:
    """Sink messages without a producer record."""
    return consumed.select(key).distinct().join(produced.select(key), key, "left_anti")


def latency_percentiles(latency: DataFrame, *group: str, value: str = "latency", approximate: bool = False) -> DataFrame:
    """p10, p50 and p90 per group, interpolated; nulls do not count, and a group of nothing else has null percentiles.

    Values are ranked by ranges, and the two beside each percentile picked by their places, so that a group of any size
    takes no more memory than others. ``approximate`` reads the values once and writes nothing instead."""
    points = [0.1, 0.5, 0.9]
    names = [f"p{round(100 * x)}" for x in points]
    if approximate:
        rows = latency.groupBy(*group).agg(F.percentile_approx(value, points, 10000).alias("_p"))
        return rows.select(*group, *[F.col("_p")[i].alias(n) for i, n in enumerate(names)])
    v, i = unused([*group, *names], "_value", "_i")
    rows = latency.select(*group, F.col(value).cast("double").alias(v))
    placed = with_row_index(rows.filter(F.col(v).isNotNull()), *group, v, name=i)
    groups = placed.groupBy(*group).agg(F.min(i).alias("_start"), F.count("*").alias("_n"))
    place = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x")) for k, x in enumerate(points)])).alias("_at")
    wanted = groups.select(*group, "_start", (F.col("_n") - 1).alias("_last"), place)
    at = F.col("_at.x") * F.col("_last")
    ends = F.explode(F.array(F.struct(F.floor(at).alias("i"), (1 - (at - F.floor(at))).alias("w")), F.struct((F.floor(at) + 1).alias("i"), (at - F.floor(at)).alias("w")))).alias("_end")
    wanted = wanted.select(*group, "_start", "_at.k", ends).filter("_end.w > 0")  # two rows a group and percentile
    wanted = wanted.select(*group, "k", (F.col("_start") + F.col("_end.i")).alias("_place"), F.col("_end.w").alias("_w"))
    found = wanted.join(placed.select(i, v), F.col("_place") == F.col(i)).select(*group, "k", (F.col("_w") * F.col(v)).alias(v))
    if group:
        found = found.unionByName(rows.select(*group).distinct(), allowMissingColumns=True)
    return found.groupBy(*group).agg(*[F.sum(F.when(F.col("k") == k, F.col(v))).alias(n) for k, n in enumerate(names)])


def throughput(runs: DataFrame, *group: str) -> DataFrame:
    """(group, events, per_ms, floor_per_ms) of runs with start_ns, end_ns and events; null where no time passed."""
    rows = runs.groupBy(*group).agg(
        F.sum("events").alias("events"), ((F.max("end_ns") - F.min("start_ns")) / 1e6).alias("ms")
    )
    rate = F.try_divide(F.col("events").cast("double"), F.col("ms"))
    return rows.select(*group, "events", rate.alias("per_ms"), F.floor(rate).alias("floor_per_ms"))


def optimal_throughput(values_per_ms: float, sources: int, ratio: float) -> float:
    """Events a millisecond when nothing falls behind: the sources' values and the barriers among them."""
    return values_per_ms * sources + values_per_ms / ratio


def throughput_series(counts: DataFrame, points: int = 3) -> DataFrame:
    """(ts, rate): events a millisecond between log times, on an even grid of ``points`` times as many times.

    Counts of one time are added, zero rows at either end go, rates are resampled linearly; grid times before the first
    step take its rate. Log times are dealt into stretches of about SERIES_ROWS; what a stretch needs of those beside it
    comes from a table of one row a stretch, so a raw log may have a row a nanosecond."""
    per = counts.groupBy(F.col("ts_ns").alias("ts")).agg(F.sum("n").alias("n"))
    per = written(per, "series")
    ends = per.filter("n > 0").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    per = per.filter(F.col("ts").between(ends.a, ends.b)) if ends.a is not None else per.filter("false")
    rows = per.count()
    a, b, k = ends.a or 0, ends.b or 0, rows * points
    parts = max(1, rows // SERIES_ROWS)
    stretch = lambda t: F.least(F.floor((t - F.lit(float(a))) / F.lit((b - a) / parts or 1.0)), F.lit(parts - 1)).cast("int")

    own = per.withColumn("part", stretch(F.col("ts").cast("double")))
    line = Window.partitionBy("part").orderBy("ts")
    lasts = _beside(own.groupBy("part").agg(F.max("ts").alias("last")), parts, "last", "earlier", False)
    before = F.coalesce(F.lag("ts").over(line), F.col("earlier"))
    steps = own.join(F.broadcast(lasts), "part").withColumn("rate", F.col("n") / ((F.col("ts") - before) / 1e6)).filter("rate is not null")
    steps = steps.select("part", F.col("ts").cast("double").alias("t"), "rate", F.col("ts").cast("double").alias("st"))

    grid = per.sparkSession.range(k if k > 1 else 0).select((F.lit(a) + F.col("id") * F.lit((b - a) / max(1, k - 1))).alias("t"))
    grid = grid.select(stretch(F.col("t")).alias("part"), "t")
    both = grid.unionByName(steps, allowMissingColumns=True).withColumn("step", F.when(F.col("st").isNotNull(), F.struct("st", "rate")))
    back = Window.partitionBy("part").orderBy("t", F.col("st").asc_nulls_last())
    ahead = Window.partitionBy("part").orderBy(F.col("t").desc(), F.col("st").desc_nulls_last())
    inner = steps.groupBy("part").agg(F.max(F.struct("st", "rate")).alias("last"), F.min(F.struct("st", "rate")).alias("first"))
    sides = _beside(inner, parts, "last", "earlier", False).join(_beside(inner, parts, "first", "later", True), "part")
    near = both.join(F.broadcast(sides), "part").filter("t is not null")
    near = near.withColumns(
        {
            "s0": F.coalesce(F.last("step", ignorenulls=True).over(back), F.col("earlier")),
            "s1": F.coalesce(F.last("step", ignorenulls=True).over(ahead), F.col("later")),
        }
    )
    t0, r0, t1, r1 = (F.col(c) for c in ("s0.st", "s0.rate", "s1.st", "s1.rate"))
    share = F.try_divide(F.col("t") - t0, t1 - t0)
    rate = F.when(t0.isNull(), r1).when(t1.isNull() | (t1 == t0), r0)
    return near.filter("st is null").select(F.col("t").alias("ts"), rate.otherwise(r0 + share * (r1 - r0)).alias("rate"))


def _beside(ends: DataFrame, parts: int, end: str, name: str, later: bool) -> DataFrame:
    """(part, name): ``end`` of the nearest earlier (or later) part that has one, for each of ``parts`` parts."""
    order = F.col("part").desc() if later else F.col("part")
    frame = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    every = ends.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    return every.join(ends.select("part", end), "part", "left").select("part", F.last(end, ignorenulls=True).over(frame).alias(name))


def max_throughput(runs: DataFrame, configs: DataFrame, config: str = "config", value: str = "per_ms") -> DataFrame:
    """(config, best): the best rate of each configuration, 0 where it has no run."""
    best = runs.groupBy(config).agg(F.max(value).alias("best"))
    return configs.select(config).distinct().join(best, config, "left").fillna(0, ["best"])


def speedup(best: DataFrame, base, config: str = "config") -> DataFrame:
    """(config, best, ratio) against the configuration ``base``."""
    one = best.filter(F.col(config) == F.lit(base)).select(F.col("best").alias("_base"))
    return best.join(F.broadcast(one)).select(config, "best", F.try_divide("best", "_base").alias("ratio"))


def latency_cdf(latency: DataFrame, group: str, value: str = "latency") -> DataFrame:
    """(group, value, share): rank from 0 over the group's count. A group of any size is ranked by ranges of values."""
    placed = with_row_index(latency.select(group, value), group, value, name="_i").alias("a")
    groups = placed.groupBy(group).agg(F.min("_i").alias("start"), F.count("*").alias("n")).alias("b")
    rows = placed.join(groups, F.col(f"a.{group}").eqNullSafe(F.col(f"b.{group}")))
    return rows.select(f"a.{group}", f"a.{value}", ((F.col("_i") - F.col("start")) / F.col("n")).alias("share"))


def run_meter(sent: DataFrame, received: DataFrame) -> DataFrame:
    """One row: volume, mean latency of received rows (latency), completion time and throughput (ts in ms)."""
    a = sent.agg(F.count("*").alias("volume"), F.min("ts").alias("start"))
    b = received.agg(F.avg("latency").alias("mean_latency"), F.max("ts").alias("end"))
    took = F.col("end") - F.col("start")
    return a.crossJoin(b).select("volume", "mean_latency", took.alias("completion"), F.try_divide(F.col("volume").cast("double"), took).alias("throughput"))


def messages_per_interval(log: DataFrame, interval: str = "500 ms") -> DataFrame:
    """(node, start, n) of log rows with ts and node."""
    return log.groupBy("node", F.window("ts", interval).alias("w")).agg(F.count("*").alias("n")).select("node", F.col("w.start").alias("start"), "n")
