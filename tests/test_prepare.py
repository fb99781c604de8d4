"""Row indices, windows of null keys, running maxima and as-of joins on inputs that partitions and ties make hard."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators import asof, barrier, clock, keyed, load, meter
from tidemark.sources import generate, io, prepare


@pytest.fixture
def sixteen(spark):
    """Sixteen partitions that stay so."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("name", "order"), [("orders", ["o_orderkey"]), ("events", ["ts", "event_id"])])
def test_row_index_of_wide_tables(sixteen, name, order):
    df = sixteen.read.parquet(f"{SF}/{name}.parquet").withColumns({"p": F.lit(1), "i": F.lit(2), "o": F.lit(3), "r": F.lit(4)})
    out = prepare.with_row_index(df, *order)
    assert out.columns == [*df.columns, "row_index"]
    rows = out.collect()
    assert sorted(r.row_index for r in rows) == list(range(df.count()))
    assert [r.row_index for r in sorted(rows, key=lambda r: tuple(r[c] for c in order))] == list(range(len(rows)))
    parts = prepare.split_contiguous(df, 7, *order).groupBy("part").count().collect()
    assert sorted(r["count"] for r in parts)[1:] == [-(-len(rows) // 7)] * 6


def test_null_keys_keep_their_sums(spark):
    events = spark.createDataFrame([(1, None, 7), (3, None, 1), (1, "a", 2)], "ts long, k string, val long")
    marks = spark.createDataFrame([(2,), (4,)], "ts long")
    got = {(r.marker, r.k): r.total for r in keyed.tumbling_sum(events, marks, "k").collect()}
    assert got == {(2, None): 7, (4, None): 1, (2, "a"): 2, (4, "a"): 0}
    sparse = {(r.marker, r.k): r.total for r in keyed.tumbling_sum(events, marks, "k", every_key=False).collect()}
    assert sparse == {(2, None): 7, (4, None): 1, (2, "a"): 2}
    assert {r.total for r in keyed.sliding_sum(events, marks, "k", 2).collect()} == {8, 2}


def test_running_max_of_nanoseconds(spark):
    rng, start = random.Random(2), 1_704_067_200_000_000_000
    rows = sorted((start + rng.randrange(10**15), i, rng.choice([-1, 1])) for i in range(500))
    marks = [start + 4 * 10**14, start + 10**15]
    want, low = {}, 0
    for m in marks:
        run = high = 0
        for ts, _, d in rows:
            if low <= ts < m:
                run += d
                high = max(high, run)
        want[m], low = high, m
    df = spark.createDataFrame(rows, "ts long, seq long, delta long")
    got = {r.marker: r.high for r in keyed.net_running_max(df, spark.createDataFrame([(m,) for m in marks], "ts long")).collect()}
    assert got == want


def test_asof_joins_agree(spark, monkeypatch):
    rng = random.Random(4)
    views = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(40)]), i) for i in range(300)]
    updates = [(rng.choice([1, 2, None]), rng.randrange(40), rng.randrange(100)) for _ in range(40)]
    left, right = spark.createDataFrame(views, "k long, ts long, id long"), spark.createDataFrame(updates, "k long, ts long, v long")
    for closed in ("left", "right"):
        want = {}
        for k, ts, i in views:
            before = [(t, v) for key, t, v in updates if None not in (k, ts) and key == k and (t < ts or closed == "right" and t == ts)]
            want[i] = max(before)[1] if before else None
        known = left.filter("k is not null and ts is not null")
        for found in (asof.asof_join_small(left, right, "k", "v", closed), asof.asof_join(known, right, "k", "v", closed, bucket=7)):
            assert all(want[r.id] == r.v for r in found.collect()) and found.count() in (300, known.count())
        monkeypatch.setattr(asof, "BROADCAST_UPDATES", 3)
        many = asof.asof_join_small(known, right, "k", "v", closed, bucket=7)
        assert {r.id: r.v for r in many.collect()} == {r.id: want[r.id] for r in known.collect()}
        monkeypatch.undo()
    assert asof.asof_join_small(left, right.limit(0), "k", "v").filter("v is not null").count() == 0


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_partitions_and_order_do_not_matter(spark, parts):
    rng = random.Random(6)
    rows = [(rng.randrange(5), rng.randrange(1000), rng.randrange(50)) for _ in range(400)]
    marks = spark.createDataFrame([(m,) for m in range(100, 1001, 100)], "ts long")
    want = {m: sum(v for _, t, v in rows if m - 100 <= t < m) for m in range(100, 1001, 100)}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source int, ts long, val long").repartition(parts)
    assert {r.marker: r.total for r in barrier.barrier_window_sum(df, marks).collect()} == want
    by = keyed.tumbling_sum(df, marks, "source").groupBy("marker").agg(F.sum("total").alias("total"))
    assert {r.marker: r.total for r in by.collect()} == want
    buckets = clock._by_bucket(df, clock.marker_times(marks), "ts", "left").groupBy("marker").agg(F.sum("val").alias("total"))
    assert {r.marker: r.total for r in buckets.collect()} == want
    cdf = meter.latency_cdf(df.withColumn("latency", F.col("val").cast("double")), "source").collect()
    for s in range(5):
        own = sorted(v for k, _, v in rows if k == s)
        assert sorted((r.latency, round(r.share * len(own))) for r in cdf if r.source == s) == [(float(v), i) for i, v in enumerate(own)]


def test_optimal_throughput():
    """A published formula: each source's values, and one barrier in ``ratio`` values of one source."""
    assert meter.optimal_throughput(100.0, 4, 50.0) == 402.0


def test_result_lines_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-02 03:04:05", 7, 11, 3)], "at string, value long, ts long, latency long")
    rows, path = rows.withColumn("at", F.col("at").cast("timestamp")), f"file://{tmp_path}/lines"
    io.write_result_lines(rows, path)
    io.write_result_lines(rows, path, mode="append")
    assert [r.value for r in spark.read.text(path).collect()] == ["2024-01-02T03:04:05.000 7 @ 11 [latency: 3 ms]"] * 2
    io.write_result_lines(rows, path)
    assert spark.read.text(path).count() == 1


def test_fold_in_many_parts(spark):
    """The same states for any number of partitions; a null state where a window is empty."""
    rows = [(t, t % 7) for t in range(300)]
    marks = spark.createDataFrame([(100,), (150,), (150,), (400,), (500,)], "ts long")
    want = {100: (0, 6), 150: (0, 6), 400: (0, 6), 500: (None, None)}
    for parts in (1, 9):
        df = spark.createDataFrame(rows, "ts long, val long").repartition(parts)
        ends = lambda a, b: {"low": int(a.min()), "high": int(b.max())}
        out = barrier.sync_fold(df, marks, lambda r: ends(r["val"], r["val"]), lambda s: ends(s["low"], s["high"]), "low long, high long")
        assert {r.marker: (r.low, r.high) for r in out.collect()} == want


@pytest.mark.parametrize("bucket", [1, 7, 50, 10_000])
def test_distances_by_bucket(spark, bucket):
    """One key with all points, and keys with holes; the same distances however the points are dealt."""
    rng = random.Random(bucket)
    rows = [(1, rng.randrange(1000), rng.random() * 9, rng.random() * 9) for _ in range(600)]
    rows += [(rng.choice([2, 3, None]), rng.choice([*range(300), *range(900, 1000)]), 1.0 * (i % 5), None if i % 17 == 0 else 2.0) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, ts long, x double, y double")
    marks = spark.createDataFrame([(m,) for m in range(100, 1001, 100)], "ts long")
    plain = {(r.marker, r.k): r.distance for r in keyed.distance_per_window(df, marks, "k", 6).collect()}
    dealt = {(r.marker, r.k): r.distance for r in keyed.distance_per_window(df, marks, "k", 6, bucket).collect()}
    assert plain == pytest.approx(dealt, abs=2e-6) and len(plain) == 40


def test_load_spine_without_nested_loops(spark):
    df = spark.createDataFrame([(1, 1, 1, 5, 2.0), (2, 3, 9, 15, 8.0)], "house int, household int, plug int, ts long, val double")
    found = load.load_summaries(df, spark.range(10, 40, 10).withColumnRenamed("id", "ts"))
    assert found.count() == 3 * 4 + 2 * 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_percentiles_by_rank(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.random(), float(rng.randrange(4))])) for _ in range(500)] + [("c", None), ("d", 2.5)]
    df = spark.createDataFrame(rows, "g string, latency double")
    built = df.groupBy("g").agg(F.expr("percentile(latency, array(0.1, 0.5, 0.9))").alias("p")).collect()
    want = {r.g: pytest.approx(r.p) if r.p else [None] * 3 for r in built}
    got = {r.g: [r.p10, r.p50, r.p90] for r in meter.latency_percentiles(df.repartition(5), "g").collect()}
    assert got == want and len(got) == 5
    one = meter.latency_percentiles(df).first()
    assert [one.p10, one.p50, one.p90] == pytest.approx(df.selectExpr("percentile(latency, array(0.1, 0.5, 0.9)) AS p").first().p)
    assert tuple(meter.latency_percentiles(df.limit(0)).first()) == (None, None, None)


@pytest.mark.parametrize("size", [1, 5, 65_536])
def test_throughput_series_in_stretches(spark, monkeypatch, size):
    """The same series however the log times are dealt; holes leave stretches empty; no window over all log times."""
    rng = random.Random(3)
    times = sorted(rng.sample([*range(0, 4000), *range(60_000, 61_000), *range(990_000, 1_000_000)], 120))
    rows = [(t * 1000, rng.choice([0, 1, 5])) for t in times] + [(times[5] * 1000, 2)]
    df = spark.createDataFrame(rows, "ts_ns long, n long")
    whole = sorted(map(tuple, meter.throughput_series(df).collect()))
    monkeypatch.setattr(meter, "SERIES_ROWS", size)
    found = meter.throughput_series(df)
    assert len(whole) > 300 and np.allclose(sorted(map(tuple, found.collect())), whole)
    assert meter.throughput_series(df.limit(0)).count() == 0 == meter.throughput_series(df.filter("n = 0")).count()


def test_states_from_changes(spark):
    rng = random.Random(2)
    rows = [(m, k, rng.choice([1, 1, 2, None])) for m in range(0, 100, 10) for k in ("a", "b", "c", None) if rng.random() < 0.7]
    df = spark.createDataFrame([*rows, (200, "z", 1)], "marker long, k string, v long")
    changes = io.state_changes(df, "k")
    assert 0 < changes.count() < len(rows) * 2
    again = io.states(changes, df, "k")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, df.select(again.columns).collect()), key=str)
    for m in (0, 35, 90, 150, 300):
        last = max(x for x in [*range(0, 100, 10), 200] if x <= m)
        want = sorted(((k, v) for t, k, v in [*rows, (200, "z", 1)] if t == last), key=str)
        assert sorted(map(tuple, io.state_at(changes, m, "k").collect()), key=str) == want


def test_accelerated_rate(spark):
    """By any time t there are t / period + a / 2 * t ** 2 events, rounded down."""
    times = sorted(r.ts for r in generate.gen_rate(spark, 100, 0.5, 0.2).collect())
    assert len(times) == int(100 / 0.5 + 0.1 * 100 * 100) and times[-1] <= 100
    for t in range(1, 101):
        made = sum(x <= t + 1e-9 for x in times)
        assert abs(made - (t / 0.5 + 0.1 * t * t)) <= 1 and made <= t / 0.5 + 0.1 * t * t + 1e-6


def test_generated_zips(spark):
    """Five digits, evenly spread, the same for a seed, and different for other users, times and seeds."""
    zips = lambda seed: {(r.user_id, r.ts): r.zip for r in generate.gen_get_update(spark, 400_000, 20, seed).filter("kind = 'update'").collect()}
    one, again, other = zips(1), zips(1), zips(2)
    assert one == again and len(one) == 800 and all(10_000 <= z <= 99_999 for z in one.values())
    assert len(set(one.values())) > 780 and sum(one[k] == other[k] for k in one) < 5
    low, high = sum(z < 40_000 for z in one.values()), sum(z >= 70_000 for z in one.values())
    assert 200 < low < 334 and 200 < high < 334
