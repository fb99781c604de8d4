"""Streams of many files give what the batch jobs give, whatever arrives when; state holds what still waits."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.operators import asof, barrier
from tidemark.plans import events as ev
from tidemark.plans import records
from tidemark.streaming import stream

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, val long"
FILES = 20


@pytest.fixture(scope="module")
def recorded(spark, tmp_path_factory):
    """The events by time in FILES files, and the same as a table; one user has a third of them."""
    path = tmp_path_factory.mktemp("files")
    rows = ev.events(spark, SMALL).select("event_id", (F.timestamp_micros("ts")).alias("ts"), "user_id", "event_type", "val")
    rows = rows.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id"))).toPandas().sort_values("ts")
    step = -(-len(rows) // FILES)
    for i in range(FILES):
        part = spark.createDataFrame(rows[i * step : (i + 1) * step], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(f"file://{path}/in")
    return f"file://{path}/in", spark.createDataFrame(rows, SCHEMA).withColumn("us", F.unix_micros("ts"))


def replay(spark, recorded, kind=None, files=4):
    """``files`` files a batch."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(recorded[0]).withWatermark("ts", "0 seconds")
    return rows.filter(kind) if kind else rows


def test_barrier_sums(spark, recorded):
    table = recorded[1]
    for width in (50, 4096):
        out = stream.stream_barrier_sum(replay(spark, recorded, "event_type <> 'signup'", 2), replay(spark, recorded, "event_type = 'signup'", 1), 3, width)
        got = {r.marker_us: r.t for r in records._drained(spark, out, "t").groupBy("marker_us").agg(F.sum("total").alias("t")).collect()}
        batch = table.select("event_type", F.col("us").alias("ts"), "val", F.lit(0).alias("source"))
        want = {r.marker: r.total for r in barrier.barrier_window_sum(batch.filter("event_type <> 'signup'"), batch.filter("event_type = 'signup'")).collect()}
        last = max(want) // 1000
        assert got == {m: t for m, t in want.items() if m // 1000 < last} and len(got) > 100


@pytest.mark.parametrize("width", [3, 4096])
def test_asof_join(spark, recorded, width):
    table = recorded[1].select("event_id", "user_id", "event_type", F.col("us").alias("ts"), F.col("val"))
    views, updates = replay(spark, recorded, "event_type = 'view'"), replay(spark, recorded, "event_type = 'signup'")
    out = records._drained(spark, stream.stream_asof_join(views.withColumn("id", F.col("event_id")), updates, "user_id", "val", width), "t")
    got = {r.id: r.val for r in out.collect()}
    batch = asof.asof_join(table.filter("event_type = 'view'"), table.filter("event_type = 'signup'"), "user_id", "val")
    upto = min(r[0] for r in table.filter("event_type in ('view', 'signup')").groupBy("event_type").agg(F.max("ts")).select("max(ts)").collect())
    assert got == {r.event_id: r.val for r in batch.collect() if r.ts // 1000 < upto // 1000}
    assert len(got) > 100 and None in got.values()


@pytest.mark.parametrize("forget_ms", [None, 86_400_000])
def test_asof_join_keeps_keys_together(spark, recorded, forget_ms):
    """Few buckets of many keys give what a bucket for nearly every key gives."""
    rows = {}
    for buckets in (2, 1 << 40):
        views, updates = replay(spark, recorded, "event_type = 'view'"), replay(spark, recorded, "event_type = 'signup'")
        out = stream.stream_asof_join(views.withColumn("id", F.col("event_id")), updates, "user_id", "val", 50, forget_ms, buckets)
        rows[buckets] = sorted((r.id, r.key, r.us, str(r.val)) for r in records._drained(spark, out, "t").collect())
    assert rows[2] == rows[1 << 40] and len(rows[2]) > 100
    assert len({k for _, k, _, _ in rows[2]}) > 10


def test_old_values_are_forgotten(spark, recorded):
    day = 86_400_000
    views, updates = replay(spark, recorded, "event_type = 'view'"), replay(spark, recorded, "event_type = 'signup'")
    out = records._drained(spark, stream.stream_asof_join(views.withColumn("id", F.col("event_id")), updates, "user_id", "val", forget_ms=day), "t")
    rows = recorded[1].collect()
    by_user = {}
    for r in sorted((r for r in rows if r.event_type == "signup"), key=lambda r: (r.us, r.val)):
        by_user.setdefault(r.user_id, []).append((r.us, r.val))
    got, want = {r.id: r.val for r in out.collect()}, {}
    for r in rows:
        if r.event_type == "view" and r.event_id in got:
            before = [x for x in by_user.get(r.user_id, []) if x[0] < r.us]
            want[r.event_id] = before[-1][1] if before and r.us - before[-1][0] < day * 1000 else None
    assert got == want and sum(v is not None for v in got.values()) > 5


def test_windows_and_fraud(spark, recorded):
    """The queries over one file and the same stream over twenty."""
    table, end = recorded[1], recorded[1].agg(F.max("ts")).first()[0]
    day = F.window("ts", "1 day").alias("w")
    out = records._drained(spark, stream.stream_tumbling(replay(spark, recorded), "1 day", "user_id"), "t")
    want = table.groupBy(day, "user_id").agg(F.sum("val").alias("total")).select(F.col("w.end").alias("marker"), "user_id", "total")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.filter(F.col("marker") <= F.lit(end)).collect()))
    out = records._drained(spark, stream.stream_sliding(replay(spark, recorded), "1 day", "8 hours"), "t")
    want = table.groupBy(F.window("ts", "1 day", "8 hours").alias("w")).agg(F.sum("val").alias("total")).select(F.col("w.end").alias("marker"), "total")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.filter(F.col("marker") <= F.lit(end)).collect()))
    sums = {r.w.end: r.t for r in table.groupBy(day).agg(F.sum("val").alias("t")).collect()}
    out = records._drained(spark, stream.stream_fraud(replay(spark, recorded).select("ts", "event_id", "val"), "1 day", 86_400, 10), "t")
    flagged = set()
    for r in table.select("*", day).collect():
        start = r.w.start
        if start in sums and sums[start] % 10 == r.val % 10 and start <= end:
            flagged.add(r.event_id)
    assert {r.event_id for r in out.collect()} == flagged and flagged
    keys = replay(spark, recorded).select("ts", "val", F.floor(F.col("user_id") / 15).alias("house"), F.floor(F.col("user_id") / 3).alias("household"), F.col("user_id").alias("plug"))
    out = records._drained(spark, stream.stream_load_summaries(keys, "1 day"), "t").collect()
    whole = {r.marker: (r.total, r.n) for r in out if r.house is None}
    assert whole == {r.w.end: (r.t, r.n) for r in table.groupBy(day).agg(F.sum("val").alias("t"), F.count("*").alias("n")).collect() if r.w.end <= end}
    for level in ("house", "household", "plug"):
        finer = {}
        for r in out:
            levels = [r.house, r.household, r.plug]
            if sum(x is not None for x in levels) == 1 + ["house", "household", "plug"].index(level):
                finer[r.marker] = finer.get(r.marker, 0) + r.n
        assert finer == {m: n for m, (_, n) in whole.items()}


def test_a_late_source_holds_the_others_back(spark, tmp_path):
    """The watermark of a union is the least of its sources': windows stay open until the slow one has passed them."""
    def source(name, days):
        for d in days:
            spark.createDataFrame([(f"2024-01-{d:02d} 12:00:00", 1)], "ts string, val long").select(F.col("ts").cast("timestamp").alias("ts"), "val").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{name}")
        return spark.readStream.schema("ts timestamp, val long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/{name}")

    both = stream.watermarked(source("fast", [1, 5, 9, 12]), source("slow", [1, 2, 3, 3]))
    out = records._drained(spark, stream.stream_tumbling(both, "1 day"), "t")
    assert {(r.marker.day, r.total) for r in out.collect()} == {(2, 2), (3, 1)}
