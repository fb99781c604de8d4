"""Markers and as-of joins on nanoseconds, nulls, clashing names and both ways of meeting."""

import random
from bisect import bisect_left, bisect_right

import numpy as np
import pytest

from tidemark.operators import asof, barrier, clock

BASE = 1_700_000_000_000_000_000


def by_hand(ts, marks, closed):
    if ts is None:
        return None, None
    k = (bisect_right if closed == "left" else bisect_left)(marks, ts)
    return (marks[k] if k < len(marks) else None), (marks[k - 1] if k else None)


def placed(df):
    return {r.id: (r.marker, r.previous) for r in df.collect()}


@pytest.mark.parametrize("closed", ["left", "right"])
@pytest.mark.parametrize("many", [0, 1, 3, 700])
def test_nanoseconds_beside_nulls(spark, monkeypatch, closed, many):
    """Some of the times are null, some equal markers, some lie before the first or after the last; steps of a few ns."""
    rng = random.Random(many)
    marks = sorted({BASE + rng.randrange(4000) for _ in range(many)})
    times = [None, BASE - 5, BASE + 9000, *[BASE + rng.randrange(-50, 4050) for _ in range(2000)], *marks, None]
    events = spark.createDataFrame(list(enumerate(times)), "id long, ts long")
    markers = spark.createDataFrame([(m,) for m in marks * 2] + [(None,)], "ts long")
    want = {i: by_hand(t, marks, closed) for i, t in enumerate(times)}
    assert placed(clock.assign_marker(events, markers, closed=closed)) == want
    monkeypatch.setattr(clock, "BROADCAST_MARKERS", 0)
    monkeypatch.setattr(clock, "BUCKET_MARKERS", 16)
    assert placed(clock.assign_marker(events, markers, closed=closed)) == want
    monkeypatch.setattr(clock, "BUCKETS", 3)
    assert placed(clock.assign_marker(events, markers, closed=closed)) == want


def test_buckets_follow_crowded_markers(spark):
    """Nearly all markers in one millisecond, one a year away: buckets hold about as many markers each."""
    times = spark.createDataFrame([(BASE + i,) for i in range(40_000)] + [(BASE + 10**17,)], "ts long")
    starts = clock.bucket_starts(clock.marker_times(times))
    assert 100 <= len(starts) <= 160 and np.diff(starts)[:-1].max() < 4 * clock.BUCKET_MARKERS


def test_bucket_frames_only_grow(spark):
    """Linear: no frame of a bucket reaches forward."""
    e = spark.range(10).selectExpr("id", "id AS ts")
    plan = clock._by_bucket(e, clock.marker_times(e), "ts", "left")._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan.lower() and "BroadcastNestedLoop" not in plan


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_columns_of_any_name(spark, monkeypatch, bound):
    """Columns called like internal ones stay; ``marker`` and ``previous`` are replaced."""
    monkeypatch.setattr(clock, "BROADCAST_MARKERS", bound)
    row = (0, 7, 3, -1, -2, 10, 20, 30, 40, 50, 60, 70)
    names = "source int, ts long, val long, marker long, previous long, _w long, _b long, _t long, _r long, _m long, _own long, _start long"
    events = spark.createDataFrame([row], names)
    marks = spark.createDataFrame([(5,), (9,)], "ts long")
    got = clock.assign_marker(events, marks).first().asDict()
    assert got == dict(zip([c.split()[0] for c in names.split(", ")], row, strict=True)) | {"marker": 9, "previous": 5}
    assert {r.marker: r.total for r in barrier.barrier_window_sum(events, marks).collect()} == {5: 0, 9: 3}
    flags = barrier.fraud_flags(events.drop("marker", "previous"), marks, 3).first().asDict()
    assert flags == {k: v for k, v in got.items() if k not in ("marker", "previous")}


def test_fraud_by_bucket(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(0, rng.randrange(3000), rng.randrange(20)) for _ in range(1500)]
    events = spark.createDataFrame(rows, "source int, ts long, val long")
    marks = spark.createDataFrame([(rng.randrange(3000),) for _ in range(300)], "ts long")
    find = lambda: [sorted(map(tuple, f.collect())) for f in (barrier.fraud_flags(events, marks, 5), barrier.fraud_stream(events, marks, 5), barrier.fraud_flags_count_model(events, marks, 5), barrier.modulo_match(events, marks, 5))]
    want = find()
    monkeypatch.setattr(clock, "BROADCAST_MARKERS", 0)
    monkeypatch.setattr(clock, "BUCKET_MARKERS", 16)
    assert find() == want and all(want)


@pytest.mark.parametrize("closed", ["left", "right"])
def test_null_keys_find_nothing(spark, monkeypatch, closed):
    """Four ways, one rule; columns called like internal ones stay, one called like the value is replaced."""
    rng = random.Random(5)
    views = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(60)]), i, -7, -8, -9, -10) for i in range(400)]
    updates = [(rng.choice([1, 2, None]), rng.choice([None, *range(60)]), rng.choice([None, *range(100)])) for _ in range(80)]
    left = spark.createDataFrame(views, "k long, ts long, id long, v long, _b long, _own long, _end long")
    right = spark.createDataFrame(updates, "k long, ts long, v long")
    want = {}
    for k, ts, i, *_ in views:
        before = [(t, v) for key, t, v in updates if None not in (k, ts, t, v) and key == k and (t < ts or closed == "right" and t == ts)]
        want[i] = max(before)[1] if before else None
    ways = [asof.asof_join(left, right, "k", "v", closed), asof.asof_join(left, right, "k", "v", closed, bucket=7), asof.asof_join_small(left, right, "k", "v", closed)]
    monkeypatch.setattr(asof, "BROADCAST_UPDATES", 3)
    ways.append(asof.asof_join_small(left, right, "k", "v", closed, bucket=7))
    for found in ways:
        rows = found.collect()
        assert {r.id: r.v for r in rows} == want and len(rows) == len(views)
        assert {(r["_b"], r["_own"], r["_end"]) for r in rows} == {(-8, -9, -10)}


def test_forward_joins_agree(spark):
    rng = random.Random(6)
    views = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(60)]), i) for i in range(300)]
    updates = [(rng.choice([1, 2, None]), rng.choice([None, *range(70)]), rng.randrange(9)) for _ in range(60)]
    left, right = spark.createDataFrame(views, "k long, ts long, id long"), spark.createDataFrame(updates, "k long, ts long, v long")
    want = []
    for k, ts, i in views:
        later = [t for key, t, _ in updates if None not in (k, ts, t) and key == k and t >= ts]
        want += [(i, t, v) for key, t, v in updates if later and key == k and t == min(later)]
    for bucket in (None, 1, 7):
        got = [(r.id, r.update_ts, r.v) for r in asof.forward_asof_join(left, right, "k", "v", bucket).collect()]
        assert sorted(got) == sorted(want) and want


def test_one_key_in_many_buckets(spark):
    """250,000 buckets of one key, whose carries are found in linear time."""
    rows = spark.range(250_000).selectExpr("1L AS k", "id * 10 AS ts", "id")
    updates = spark.createDataFrame([(1, 0, 5), (1, 2_499_995, 6)], "k long, ts long, v long")
    nexts = asof.forward_asof_join(rows, updates, "k", "v", 10)
    assert {tuple(r) for r in nexts.groupBy("v").count().collect()} == {(5, 1), (6, 249_999)}
