"""Queries of the marker, window and join operators over ``events``, with their DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, barrier, clock, keyed, load

DAY, HOURS8, HOURS6 = 86_400_000_000, 28_800_000_000, 21_600_000_000
START = 1_704_067_200_000_000  # 2024-01-01 in microseconds


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ts in microseconds, val in cents and a source of four."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        "user_id",
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("val"),
        (F.col("user_id") % 4).cast("int").alias("source"),
        "props",
        "value",
    )


def values(e: DataFrame) -> DataFrame:
    return e.filter("event_type <> 'signup'")


def barriers(e: DataFrame) -> DataFrame:
    return e.filter("event_type = 'signup'").select("ts")


def every(spark: SparkSession, size: int, days: int = 30) -> DataFrame:
    """Periodic markers over the recorded month."""
    return spark.range(1, days * DAY // size + 1).select((F.lit(START) + F.col("id") * size).alias("ts"))


BASE = """e AS (SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS val,
  CAST(user_id % 4 AS INTEGER) AS source, props, value FROM events),
b AS (SELECT DISTINCT ts FROM e WHERE event_type = 'signup'),
v AS (SELECT * FROM e WHERE event_type <> 'signup'),
line AS (SELECT ts AS marker, lag(ts) OVER (ORDER BY ts) AS previous FROM b),
lp AS (SELECT v.*, l.marker, l.previous FROM v ASOF JOIN line l ON v.ts < l.marker),
p AS (SELECT v.*, lp.marker, coalesce(lp.previous, CASE WHEN lp.marker IS NULL THEN (SELECT max(ts) FROM b) END) AS previous
      FROM v LEFT JOIN lp USING (event_id)),
w AS (SELECT marker, coalesce(sum(val), 0)::BIGINT AS total, count(val) AS n FROM line LEFT JOIN p USING (marker) GROUP BY marker)"""


def sql(body: str, more: str = "") -> str:
    return f"WITH {BASE}{', ' + more if more else ''} {body}"


def _grid(size: int) -> str:
    return f"g AS (SELECT {START} + i * {size} AS marker FROM range(1, {30 * DAY // size + 1}) t(i))"


def _tumble(size: int) -> str:
    return f"""{_grid(size)}, k AS (SELECT DISTINCT user_id FROM v),
t AS (SELECT user_id, {START} + ((ts - {START}) // {size} + 1) * {size} AS marker, sum(val) AS total FROM v GROUP BY ALL),
d AS (SELECT g.marker, k.user_id, coalesce(t.total, 0)::BIGINT AS total FROM g CROSS JOIN k LEFT JOIN t USING (marker, user_id))"""


Q, O = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return add


@query("merge_ordered", sql("SELECT *, row_number() OVER (ORDER BY ts, event_type, source) AS place FROM e"))
def _(spark, sf):
    from ..sources.prepare import with_row_index

    e = events(spark, sf).withColumnRenamed("event_type", "tag")
    merged = clock.merge_ordered(*[e.filter(F.col("source") == s) for s in range(4)])
    rows = with_row_index(merged, "ts", "tag", "source", name="i").withColumn("place", F.col("i") + 1)
    return rows.drop("i").withColumnRenamed("tag", "event_type")


@query(
    "complete_until",
    sql("SELECT released, count(*) AS n, max(ts) AS last_ts FROM (SELECT ts, ts <= (SELECT min(m) FROM (SELECT max(ts) AS m FROM e GROUP BY source)) AS released FROM e) GROUP BY released"),
)
def _(spark, sf):
    rows = clock.complete_until(events(spark, sf))
    return rows.groupBy("released").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query("reclock", sql("SELECT event_id, (SELECT min(ts) FROM b WHERE b.ts >= v.ts) AS ts FROM v WHERE ts <= (SELECT max(ts) FROM b)"))
def _(spark, sf):
    e = events(spark, sf)
    return clock.reclock(values(e), barriers(e)).select("event_id", "ts")


@query("assign_marker", sql("SELECT event_id, marker, previous FROM p"))
def _(spark, sf):
    e = events(spark, sf)
    return clock.assign_marker(values(e), barriers(e)).select("event_id", "marker", "previous")


@query("assign_marker_by_bucket", sql("SELECT event_id, marker, previous FROM p"))
def _(spark, sf):
    e = events(spark, sf)
    return clock._by_bucket(values(e), clock.marker_times(barriers(e)), "ts", "left").select("event_id", "marker", "previous")


@query("hour_of_day", sql("SELECT CAST(hour(make_timestamp(ts)) AS INTEGER) AS hour, count(*) AS n FROM e GROUP BY 1"))
def _(spark, sf):
    return events(spark, sf).groupBy(clock.hour_of_day(F.col("ts"), "us").alias("hour")).agg(F.count("*").alias("n"))


@query("only_kind", sql("SELECT event_id, event_type FROM e WHERE event_type IN ('click', 'view')"))
def _(spark, sf):
    return clock.only_kind(events(spark, sf), ["click", "view"], "event_type").select("event_id", "event_type")


@query("barrier_cumulative_sum", sql("SELECT marker, CAST(sum(total) OVER (ORDER BY marker) AS BIGINT) AS total FROM w"))
def _(spark, sf):
    e = events(spark, sf)
    return barrier.barrier_cumulative_sum(values(e), barriers(e))


@query("barrier_window_sum", sql("SELECT marker, total FROM w"))
def barrier_window_sum(spark, sf):
    e = events(spark, sf)
    return barrier.barrier_window_sum(values(e), barriers(e))


@query(
    "barrier_sum_by_source",
    sql("SELECT marker, source, sum(val)::BIGINT AS total FROM p WHERE marker IS NOT NULL GROUP BY ALL UNION ALL SELECT marker, NULL, total FROM w"),
)
def _(spark, sf):
    e = events(spark, sf)
    return barrier.barrier_sum_by_source(values(e), barriers(e))


@query(
    "heartbeat_then_barrier_sum",
    sql(
        f"SELECT {START} + i * {DAY} AS marker, coalesce(sum(val), 0)::BIGINT AS total, count(val) AS n_intervals FROM range(1, 31) t(i) LEFT JOIN hb ON hb.marker = {START} + i * {DAY} GROUP BY 1",
        f"h AS (SELECT {START} + CAST(ceil((ts - {START}) / 3600000000.0) AS BIGINT) * 3600000000 AS beat, sum(val) AS val FROM v GROUP BY 1), hb AS (SELECT val, {START} + CAST(ceil((beat - {START}) / {DAY}.0) AS BIGINT) * {DAY} AS marker FROM h)",
    ),
)
def _(spark, sf):
    e = events(spark, sf)
    return barrier.heartbeat_then_barrier_sum(values(e), every(spark, 3_600_000_000), every(spark, DAY))


_HOURLY = "SELECT ts // 3600000000 AS ts, source, val FROM v"


def _hourly(spark, sf):
    return values(events(spark, sf)).withColumn("ts", F.floor(F.col("ts") / 3_600_000_000))


@query("sum_by_timestamp", sql(f"SELECT ts, source, sum(val)::BIGINT AS total FROM ({_HOURLY}) GROUP BY ALL"))
def _(spark, sf):
    return barrier.sum_by_timestamp(_hourly(spark, sf), "source")


@query("count_by_timestamp", sql(f"SELECT ts, count(*) AS n FROM ({_HOURLY}) GROUP BY ts"))
def _(spark, sf):
    return barrier.count_by_timestamp(_hourly(spark, sf))


@query(
    "modulo_match",
    sql("SELECT 'value' AS kind, ts, val FROM p WHERE val % 100 = coalesce((previous + 1) % 100, 0) UNION ALL SELECT 'sum', marker, CAST(sum(total) OVER (ORDER BY marker) AS BIGINT) FROM w"),
)
def _(spark, sf):
    e = events(spark, sf)
    return barrier.modulo_match(values(e), barriers(e))


_FLAGS = "SELECT event_id, p.ts, val FROM p LEFT JOIN w ON p.previous = w.marker WHERE coalesce(w.total, 0) % {m} = val % {m}"


@query("fraud_flags", sql(_FLAGS.format(m=100)))
def _(spark, sf):
    e = events(spark, sf)
    return barrier.fraud_flags(values(e), barriers(e), 100).select("event_id", "ts", "val")


@query("fraud_stream", sql(f"SELECT 'transaction' AS kind, ts, val FROM ({_FLAGS.format(m=1000)}) UNION ALL SELECT 'rule', marker, total FROM w"))
def _(spark, sf):
    e = events(spark, sf)
    return barrier.fraud_stream(values(e), barriers(e))


@query(
    "fraud_flags_count_model",
    sql("SELECT event_id, val FROM p LEFT JOIN w ON p.previous = w.marker WHERE p.marker IS NOT NULL AND coalesce(w.n, 0) % 1000 = val"),
)
def _(spark, sf):
    e = events(spark, sf)
    return barrier.fraud_flags_count_model(values(e), barriers(e)).select("event_id", "val")


@query("rewindow_reduce", sql(f"SELECT ts // {DAY} * {DAY} AS window_start, sum(val)::BIGINT AS total FROM v GROUP BY 1"))
def _(spark, sf):
    return barrier.rewindow_reduce(values(events(spark, sf)), DAY)


@query("window_all", sql("SELECT sum(val)::BIGINT AS total, max(ts) AS last_ts FROM v HAVING count(*) > 0"))
def _(spark, sf):
    return barrier.window_all(values(events(spark, sf)), F.sum("val").alias("total"), F.max("ts").alias("last_ts"))


@query("window_all_per_partition", sql("SELECT source, sum(val)::BIGINT AS total FROM v GROUP BY source"))
def _(spark, sf):
    return barrier.window_all_per_partition(values(events(spark, sf)), "source", F.sum("val").alias("total"))


@query(
    "sync_aggregate",
    sql("SELECT line.marker, coalesce(max(val), 0) AS high, count(val) AS n, CASE WHEN count(val) > 0 THEN round(sum(val) / count(val), 4) ELSE 0.0 END AS mean FROM line LEFT JOIN p USING (marker) GROUP BY 1"),
)
def _(spark, sf):
    e = events(spark, sf)
    out = barrier.sync_aggregate(
        values(e),
        barriers(e),
        {"h": F.max("val"), "c": F.count("*"), "s": F.sum("val")},
        {"high": F.max("h"), "n": F.sum("c"), "s": F.sum("s")},
        finish={"mean": F.when(F.col("n") > 0, F.round(F.col("s") / F.col("n"), 4)).otherwise(0.0)},
    )
    return out.drop("s")


@query("sync_fold", sql("SELECT line.marker, bit_xor(val) AS bits, count(val) AS n FROM line LEFT JOIN p USING (marker) GROUP BY 1"))
def _(spark, sf):
    e = events(spark, sf)
    xor = lambda c: int(np.bitwise_xor.reduce(c.to_numpy()))
    out = barrier.sync_fold(
        values(e).select("ts", "val"),
        barriers(e),
        lambda rows: {"bits": xor(rows["val"]), "n": len(rows)},
        lambda states: {"bits": xor(states["bits"]), "n": int(states["n"].sum())},
        "bits long, n long",
    )
    return out.fillna(0, ["n"])


@query("tumbling_sum", sql("SELECT marker, user_id, total FROM d", _tumble(DAY)))
def _(spark, sf):
    return keyed.tumbling_sum(values(events(spark, sf)), every(spark, DAY), "user_id")


@query(
    "sliding_sum",
    sql("SELECT marker, user_id, s::BIGINT AS total FROM (SELECT marker, user_id, sum(total) OVER r AS s, row_number() OVER (PARTITION BY user_id ORDER BY marker) AS k FROM d WINDOW r AS (PARTITION BY user_id ORDER BY marker ROWS 2 PRECEDING)) WHERE k >= 3", _tumble(HOURS8)),
)
def _(spark, sf):
    return keyed.sliding_sum(values(events(spark, sf)), every(spark, HOURS8), "user_id")


@query(
    "distance_per_window",
    sql(
        "SELECT g.marker, k.user_id, round(coalesce(sum(s.step), 0.0), 3) AS distance FROM g CROSS JOIN (SELECT DISTINCT user_id FROM e) k LEFT JOIN s ON s.marker = g.marker AND s.user_id = k.user_id GROUP BY 1, 2",
        f"{_grid(DAY)}, xy AS (SELECT user_id, ts, value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y FROM e), s AS (SELECT user_id, {START} + ((ts - {START}) // {DAY} + 1) * {DAY} AS marker, sqrt(power(x - lag(x) OVER o, 2) + power(y - lag(y) OVER o, 2)) AS step FROM xy WINDOW o AS (PARTITION BY user_id ORDER BY ts))",
    ),
)
def _(spark, sf):
    y = F.get_json_object("props", "$.k").cast("double")
    points = events(spark, sf).select("user_id", "ts", F.col("value").alias("x"), y.alias("y"))
    return keyed.distance_per_window(points, every(spark, DAY), "user_id", 3)


@query(
    "spike_alerts",
    sql(
        "SELECT pr.marker, pr.spike, tp.heat FROM (SELECT marker, max(rise) AS spike FROM pr GROUP BY 1) pr JOIN (SELECT marker, min(t) AS heat FROM (SELECT marker, user_id % 2, max(val) AS t FROM tp GROUP BY ALL) GROUP BY 1) tp USING (marker) WHERE spike >= 5000 AND heat >= 5000",
        f"pr AS (SELECT {START} + CAST(ceil((ts - {START}) / {HOURS8}.0) AS BIGINT) * {HOURS8} AS marker, val - lag(val, 1, 0) OVER (ORDER BY ts) AS rise FROM e WHERE event_type = 'error'), tp AS (SELECT {START} + ((ts - {START}) // {HOURS8} + 1) * {HOURS8} AS marker, user_id, val FROM e WHERE event_type = 'click')",
    ),
)
def _(spark, sf):
    e = events(spark, sf)
    pressure = e.filter("event_type = 'error'").select("ts", F.col("val").alias("pressure"))
    temps = e.filter("event_type = 'click'").select("ts", (F.col("user_id") % 2).alias("thermo"), F.col("val").alias("temp"))
    return keyed.spike_alerts(pressure, temps, every(spark, HOURS8), 5000, 5000)


@query(
    "net_running_max",
    sql(
        "SELECT line.marker, greatest(coalesce(max(r), 0), 0)::BIGINT AS high FROM line LEFT JOIN c USING (marker) GROUP BY 1",
        "c AS (SELECT marker, sum(CASE event_type WHEN 'click' THEN 1 ELSE -1 END) OVER (PARTITION BY marker ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r FROM p WHERE event_type IN ('click', 'view') AND marker IS NOT NULL)",
    ),
)
def _(spark, sf):
    e = events(spark, sf)
    steps = e.filter("event_type in ('click', 'view')").select("ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", 1).otherwise(-1).cast("long").alias("delta"))
    return keyed.net_running_max(steps, barriers(e))


def _kinds(spark, sf, size: int = 1):
    e = events(spark, sf).withColumn("ts", F.floor(F.col("ts") / size))
    pick = lambda k, v: e.filter(F.col("event_type") == k).select("event_id", "user_id", "ts", F.col("val").alias(v))
    return pick("view", "val"), pick("click", "val"), pick("signup", "zip")


def _asof(kind: str, op: str, default: str) -> str:
    left = f"(SELECT * FROM e WHERE event_type = '{kind}')"
    up = "(SELECT user_id, ts // 3600000000 AS ts, max(val) AS zip FROM e WHERE event_type = 'signup' GROUP BY 1, 2)"
    return sql(f"SELECT l.event_id, coalesce(u.zip, {default}) AS zip FROM {left} l ASOF LEFT JOIN {up} u ON l.user_id = u.user_id AND l.ts // 3600000000 {op} u.ts")


@query("asof_join", _asof("view", ">", "10000"))
def _(spark, sf):
    views, _, updates = _kinds(spark, sf, 3_600_000_000)
    return asof.asof_join(views, updates, "user_id", "zip", "left", 10000).select("event_id", "zip")


@query("asof_join_by_bucket", _asof("view", ">=", "NULL"))
def _(spark, sf):
    views, _, updates = _kinds(spark, sf, 3_600_000_000)
    return asof.asof_join(views, updates, "user_id", "zip", "right", bucket=24).select("event_id", "zip")


@query("asof_join_small", _asof("view", ">", "NULL"))
def _(spark, sf):
    views, _, updates = _kinds(spark, sf, 3_600_000_000)
    return asof.asof_join_small(views, updates, "user_id", "zip").select("event_id", "zip")


@query("lookup", _asof("click", ">", "10000"))
def _(spark, sf):
    _, gets, updates = _kinds(spark, sf, 3_600_000_000)
    return asof.lookup(gets, updates, "user_id", "zip", 10000).select("event_id", "zip")


_UP = "u AS (SELECT user_id, ts // 3600000000 AS ts, val AS zip FROM e WHERE event_type = 'signup'), l AS (SELECT event_id, user_id, ts // 3600000000 AS ts, val FROM e WHERE event_type = 'view')"


_NEXT = sql("SELECT n.event_id, n.ts, n.update_ts, u.zip FROM (SELECT l.*, (SELECT min(u.ts) FROM u WHERE u.user_id = l.user_id AND u.ts >= l.ts) AS update_ts FROM l) n JOIN u ON u.user_id = n.user_id AND u.ts = n.update_ts", _UP)


@query("forward_asof_join", _NEXT)
def _(spark, sf):
    views, _, updates = _kinds(spark, sf, 3_600_000_000)
    return asof.forward_asof_join(views, updates.select("user_id", "ts", "zip"), "user_id", "zip").select("event_id", "ts", "update_ts", "zip")


@query("forward_asof_join_by_bucket", _NEXT)
def _(spark, sf):
    views, _, updates = _kinds(spark, sf, 3_600_000_000)
    found = asof.forward_asof_join(views, updates.select("user_id", "ts", "zip"), "user_id", "zip", bucket=24)
    return found.select("event_id", "ts", "update_ts", "zip")


@query("join_by_timestamp", sql("SELECT l.event_id, ts, zip FROM l JOIN u USING (ts, user_id)", _UP))
def _(spark, sf):
    views, _, updates = _kinds(spark, sf, 3_600_000_000)
    return asof.join_by_timestamp(views, updates.select("user_id", "ts", "zip"), "user_id").select("event_id", "ts", "zip")


@query("current_table", sql("SELECT user_id, max_by(zip, ts * 1000000 + zip) AS zip, max(ts) AS ts FROM u GROUP BY 1", _UP))
def _(spark, sf):
    return asof.current_table(_kinds(spark, sf, 3_600_000_000)[2], "user_id", "zip")


@query("changelog", sql("SELECT * FROM u", _UP))
def _(spark, sf):
    return asof.changelog(_kinds(spark, sf, 3_600_000_000)[2], "user_id", "zip")


@query("relevant_updates", sql("SELECT * FROM u WHERE user_id IN (SELECT user_id FROM l WHERE val > 10000)", _UP))
def _(spark, sf):
    views, _, updates = _kinds(spark, sf, 3_600_000_000)
    return asof.relevant_updates(updates.select("user_id", "ts", "zip"), views.filter("val > 10000"), "user_id")


def _loads(spark, sf):
    e = values(events(spark, sf))
    return e.select("ts", "val", F.floor(F.col("user_id") / 15).alias("house"), F.floor(F.col("user_id") / 3).alias("household"), F.col("user_id").alias("plug"))


_LOAD = f"""r AS (SELECT val, user_id // 15 AS house, user_id // 3 AS household, user_id AS plug,
  {START} + CAST(ceil((ts - {START}) / {HOURS6}.0) AS BIGINT) * {HOURS6} AS marker FROM v),
f AS (SELECT marker, CASE WHEN marker = {START + HOURS6} THEN 0 ELSE (marker - {HOURS6}) % {DAY} // 3600000000 END AS hour,
  house, household, plug, sum(val)::BIGINT AS total, count(*) AS n FROM r
  GROUP BY GROUPING SETS ((marker), (marker, house), (marker, house, household), (marker, house, household, plug))),
{_grid(HOURS6).replace('g AS', 'gs AS')},
seen AS (SELECT house, household, plug, min(marker) AS since FROM f GROUP BY ALL),
s AS (SELECT gs.marker, seen.house, seen.household, seen.plug, coalesce(f.total, 0) AS total, coalesce(f.n, 0) AS n
  FROM gs JOIN seen ON gs.marker >= seen.since LEFT JOIN f ON f.marker = gs.marker AND f.house IS NOT DISTINCT FROM seen.house
  AND f.household IS NOT DISTINCT FROM seen.household AND f.plug IS NOT DISTINCT FROM seen.plug),
ch AS (SELECT marker, hour, house, household, plug, sum(total) OVER o AS total, sum(n) OVER o AS n FROM f
  WINDOW o AS (PARTITION BY hour, house, household, plug ORDER BY marker)),
a AS (SELECT s.marker, s.house, s.household, s.plug, CASE WHEN s.n = 0 THEN 0.0 ELSE s.total / s.n END AS slice_avg,
  coalesce((SELECT max_by(ch.total / ch.n, ch.marker) FROM ch WHERE ch.marker <= s.marker AND ch.hour = s.marker % {DAY} // 3600000000
    AND ch.house IS NOT DISTINCT FROM s.house AND ch.household IS NOT DISTINCT FROM s.household AND ch.plug IS NOT DISTINCT FROM s.plug), 0.0) AS hour_avg FROM s)"""


@query("load_summaries", sql("SELECT * FROM s", _LOAD))
def _(spark, sf):
    return load.load_summaries(_loads(spark, sf), every(spark, HOURS6), "us")


@query("load_by_hour", sql("SELECT marker, hour::INTEGER AS hour, house, household, plug, total::BIGINT AS total, n::BIGINT AS n FROM ch", _LOAD))
def _(spark, sf):
    return load.load_by_hour(_loads(spark, sf), every(spark, HOURS6), "us")


@query("load_averages", sql("SELECT marker, house, household, plug, round(slice_avg, 4) AS slice_avg, round(hour_avg, 4) AS hour_avg FROM a", _LOAD))
def _(spark, sf):
    rows = load.load_averages(_loads(spark, sf), every(spark, HOURS6), "us")
    return rows.withColumns({c: F.round(c, 4) for c in ("slice_avg", "hour_avg")})


_ALL = "(SELECT * FROM a WHERE house IS NULL) t JOIN (SELECT * FROM a WHERE house IS NOT NULL AND household IS NULL) h ON t.marker = h.marker"


@query("predict_house", sql(f"SELECT t.marker, h.house, round((t.slice_avg + t.hour_avg + h.slice_avg + h.hour_avg) / 4, 4) AS prediction FROM {_ALL}", _LOAD))
def _(spark, sf):
    rows = load.predict_house(_loads(spark, sf), every(spark, HOURS6), unit="us")
    return rows.withColumn("prediction", F.round("prediction", 4))


@query(
    "predict_plug",
    sql(
        f"SELECT t.marker, p4.house, p4.household, p4.plug, round((t.slice_avg + t.hour_avg + h.slice_avg + h.hour_avg + m.slice_avg + m.hour_avg + p4.slice_avg + p4.hour_avg) / 8, 4) AS prediction FROM {_ALL} JOIN (SELECT * FROM a WHERE household IS NOT NULL AND plug IS NULL) m ON m.marker = h.marker AND m.house = h.house JOIN (SELECT * FROM a WHERE plug IS NOT NULL) p4 ON p4.marker = m.marker AND p4.household = m.household",
        _LOAD,
    ),
)
def _(spark, sf):
    rows = load.predict_plug(_loads(spark, sf), every(spark, HOURS6), unit="us")
    return rows.withColumn("prediction", F.round("prediction", 4))


@query("merge_summaries", sql("SELECT marker, house, household, plug, sum(total)::BIGINT AS total, sum(n)::BIGINT AS n FROM f GROUP BY ALL", _LOAD))
def _(spark, sf):
    rows, slices = _loads(spark, sf), every(spark, HOURS6)
    halves = [load.load_summaries(rows.filter(F.col("plug") % 2 == k), slices, "us").filter("n > 0") for k in (0, 1)]
    return load.merge_summaries(*halves)
