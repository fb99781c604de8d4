"""Made event streams, from ranges or from the places of a table's rows.

``ids`` is a table whose ``id`` counts from 0 (``prepare.with_row_index``); streams then take their steps from it and
end with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _steps(spark: SparkSession, n: int, ids: DataFrame | None) -> DataFrame:
    return spark.range(n) if ids is None else ids.select("id").filter(F.col("id") < n)


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def gen_values(spark: SparkSession, n: int, sources: int = 1, ids: DataFrame | None = None) -> DataFrame:
    """(source, ts, val): val ts + 1 at each ts below ``n``, from every source."""
    rows = _steps(spark, n, ids).select(_each(sources).alias("source"), F.col("id").alias("ts"))
    return rows.select(F.col("source").cast("int").alias("source"), "ts", (F.col("ts") + 1).alias("val"))


gen_transactions = gen_values


def gen_barriers(spark: SparkSession, n: int, ratio: int, heartbeats: int = 1, ids: DataFrame | None = None) -> DataFrame:
    """(ts, is_heartbeat): ``heartbeats`` rows per barrier, ``ratio`` values apart each barrier, and a last heartbeat
    at ``n``."""
    i = F.col("id") + 1
    ts = F.floor(i * ratio / heartbeats).cast("long") - 1
    rows = _steps(spark, n // ratio * heartbeats, ids).select(ts.alias("ts"), (i % heartbeats != 0).alias("is_heartbeat"))
    return rows.union(spark.range(1).select(F.lit(n).cast("long"), F.lit(True)))


gen_rules = gen_barriers


def gen_page_views(spark: SparkSession, n: int, users: int, heartbeat: int = 100, ids: DataFrame | None = None) -> DataFrame:
    """(user_id, ts, kind): a view per user and ts, and a heartbeat every ``heartbeat``."""
    steps = _steps(spark, n, ids)
    views = steps.select(_each(users).alias("user_id"), F.col("id").alias("ts"), F.lit("view").alias("kind"))
    beats = steps.filter(F.col("id") % heartbeat == 0).select(F.lit(None).cast("long"), "id", F.lit("heartbeat"))
    return views.union(beats)


def gen_get_update(spark: SparkSession, n: int, users: int, seed: int = 0, ids: DataFrame | None = None) -> DataFrame:
    """(user_id, ts, kind, zip): a get one after each 1000th ts; an update 99 after each 9900th of 10000, with a zip of
    five digits from a hash of user, time and seed."""
    rows = _steps(spark, n, ids).select(_each(users).alias("user_id"), F.col("id").alias("t"))
    zips = (F.pmod(F.xxhash64("user_id", "t", F.lit(seed)), F.lit(90000)) + 10000).cast("int")
    kind = F.when(F.col("t") % 1000 == 0, "get").when(F.col("t") % 10000 == 9900, "update")
    ts = F.col("t") + F.when(F.col("kind") == "get", 1).otherwise(99)
    made = rows.withColumn("kind", kind).filter("kind is not null")
    return made.select("user_id", ts.alias("ts"), "kind", F.when(F.col("kind") == "update", zips).alias("zip"))


def gen_rate(spark: SparkSession, duration: int, period: float, acceleration: float = 0.0, ids: DataFrame | None = None) -> DataFrame:
    """(seq, ts): ``ts / period + acceleration / 2 * ts**2`` events by any time, up to ``duration``."""
    count = int(duration / period + acceleration / 2 * duration * duration)
    k, b = F.col("id") + 1, F.lit(1 / period)
    ts = k / b
    if acceleration:
        ts = (F.sqrt(b * b + 2 * acceleration * k) - b) / acceleration
    return _steps(spark, count, ids).select(F.col("id").alias("seq"), ts.alias("ts"))


def interleave_heartbeats(events: DataFrame, period: int, start: int, until: int) -> DataFrame:
    """``events`` and heartbeats (is_heartbeat, other columns null) at start + k * period below ``until``; none at the
    time of an event, and none for period 0."""
    own = events.withColumn("is_heartbeat", F.lit(False))
    if period <= 0:
        return own
    grid = events.sparkSession.range(start, until, period).select(F.col("id").alias("ts"))
    beats = grid.join(events.select(F.col("ts").cast("long").alias("ts")), "ts", "left_anti").withColumn("is_heartbeat", F.lit(True))
    return own.unionByName(beats, allowMissingColumns=True)
