"""Published outputs of the applications, on their own small inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, barrier, clock, keyed, load
from tidemark.sources import generate, io

VALUES = [(1, t, v) for t, v in [(1, 1), (3, 5), (4, 3), (7, 7), (15, 3)]]
VALUES += [(2, t, v) for t, v in [(6, 6), (8, 5), (10, 6), (11, 5), (12, 1), (13, 0), (14, 9)]]
TIPS = {
    1: "1,15 10,20 14,28 25,10 45,21 75,15 100,23 121,10 150,34 174,12 210,21 234,15 250,12",
    2: "5,25 32,26 41,10 53,24 59,30 71,15 84,29 103,21 125,18 156,12 189,21 195,15 210,18 231,12 245,21 268,15 290,12",
    3: "11,15 21,15 41,25 51,25 60,30 69,15 78,23 94,12 112,32 125,18 149,12 174,21 196,15 209,19 228,15 239,13 272,24 285,28",
}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def marks(spark, times):
    return frame(spark, [(t,) for t in times], "ts long")


def tips(spark, drivers=(1, 2, 3)):
    rows = [(d, *map(int, x.split(","))) for d in drivers for x in TIPS[d].split()]
    return frame(spark, rows, "driver int, ts long, val long")


def ordered(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("marker").collect()]


@pytest.mark.parametrize("parts", [1, 5])
def test_barrier_sums(spark, parts):
    v, b = frame(spark, VALUES, "source int, ts long, val long").repartition(parts), marks(spark, [2, 5, 9, 16])
    assert ordered(barrier.barrier_cumulative_sum(v, b), "total") == [(1,), (9,), (27,), (51,)]
    assert ordered(barrier.barrier_window_sum(v, b), "total") == [(1,), (8,), (18,), (24,)]
    by = barrier.barrier_sum_by_source(v, b).collect()
    assert {(r.marker, r.total) for r in by if r.source is None} == {(2, 1), (5, 8), (9, 18), (16, 24)}


def test_random_split(spark):
    rng = random.Random(1)
    times = [*range(1, 1001), *range(1002, 2001)]
    v = frame(spark, [(rng.randrange(2), t, t) for t in times], "source int, ts long, val long")
    assert ordered(barrier.barrier_cumulative_sum(v, marks(spark, [1001, 2001])), "total") == [(500500,), (1999999,)]


def test_closed_form(spark):
    v = spark.range(500_000).select((F.col("id") * 2 + 1).alias("ts"), (F.col("id") * 2 + 1).alias("val"))
    v = v.withColumn("source", F.lit(0)).union(v.withColumn("source", F.lit(1)))
    b = spark.range(1, 1001).select((F.col("id") * 1000).alias("ts"))
    wrong = barrier.barrier_cumulative_sum(v, b).filter(F.col("total") != F.floor(F.col("marker") * F.col("marker") / 2))
    assert wrong.count() == 0


def test_tumbling_and_sliding_tips(spark):
    rows = {(r.marker, r.driver): r.total for r in keyed.tumbling_sum(tips(spark), marks(spark, range(60, 601, 60)), "driver").collect()}
    want = [(94, 115, 80), (38, 65, 112), (56, 30, 51), (36, 66, 62), (12, 48, 52)] + [(0, 0, 0)] * 5
    assert [tuple(rows[(60 * (i + 1), d)] for d in (1, 2, 3)) for i in range(10)] == want
    slide = keyed.sliding_sum(tips(spark, (1, 2)), marks(spark, range(20, 601, 20)), "driver").collect()
    got = {(r.marker, r.driver): r.total for r in slide}
    want = "94/115 46/105 36/108 38/65 33/68 67/51 56/30 46/48 33/54 36/66 48/51 27/48 12/48 0/27 0/12".split()
    for i, pair in enumerate([*want, *["0/0"] * 13]):
        assert (got[(60 + 20 * i, 1)], got[(60 + 20 * i, 2)]) == tuple(map(int, pair.split("/")))
    assert len(got) == 56


def test_distances(spark):
    rows = [(1, t, float(t), 0.0) if t <= 1000 else (1, t, float(t), float(t - 1000)) for t in range(1, 2001)]
    rows += [(2, t, 0.0, float(t)) if t <= 1000 else (2, t, float(t - 1000), 1000.0) for t in range(1, 2001)]
    df = frame(spark, rows, "driver int, ts long, x double, y double")
    got = keyed.distance_per_window(df, marks(spark, range(60, 2041, 60)), "driver").collect()
    one = [r.distance for r in sorted(got, key=lambda r: r.marker) if r.driver == 1]
    two = [r.distance for r in sorted(got, key=lambda r: r.marker) if r.driver == 2]
    assert one == [58, *[60] * 15, 68, *[85] * 16, 30] and two == [58, *[60] * 32, 21]


def test_alert(spark):
    times = range(20, 301, 20)
    t1 = [30, 20, 47, 54, 40, 33, 20, 30, 60, 70, 49, 20, 31, 12, 21]
    t2 = [25, 26, 10, 40, 56, 20, 29, 21, 18, 80, 45, 60, 18, 12, 21]
    p = [10, 120, 50, 40, 56, 20, 29, 21, 18, 160, 280, 60, 18, 12, 21]
    temps = frame(spark, [(k, t, v) for k, vs in ((1, t1), (2, t2)) for t, v in zip(times, vs)], "thermo int, ts long, temp long")
    pressure = frame(spark, list(zip(times, p)), "ts long, pressure long")
    got = keyed.spike_alerts(pressure, temps, marks(spark, range(60, 601, 60))).collect()
    assert [tuple(r) for r in got] == [(240, 142, 70)]


def test_generators(spark):
    rows = generate.gen_barriers(spark, 100, 10, 5).collect()
    assert sorted(r.ts for r in rows if not r.is_heartbeat) == list(range(9, 100, 10))
    beats = sorted(r.ts for r in rows if r.is_heartbeat)
    assert beats[:5] == [1, 3, 5, 7, 11] and len(beats) == 41 and beats[-1] == 100
    values = generate.gen_values(spark, 10_000, 4)
    assert values.count() == 40_000
    b = generate.gen_barriers(spark, 10_000, 1000).filter("not is_heartbeat")
    sums = ordered(barrier.barrier_window_sum(values, b, "right"), "total")
    assert sums == [(4 * sum(range((k - 1) * 1000 + 1, k * 1000 + 1)),) for k in range(1, 11)]


def test_ties(spark):
    v, b = frame(spark, [(0, 5, 1), (0, 10, 2), (0, 11, 4)], "source int, ts long, val long"), marks(spark, [10, 20])
    assert ordered(barrier.barrier_window_sum(v, b, "left"), "total") == [(1,), (6,)]
    assert ordered(barrier.barrier_window_sum(v, b, "right"), "total") == [(3,), (4,)]
    views = frame(spark, [(1, 10), (1, 9), (2, 10)], "user_id long, ts long")
    updates = frame(spark, [(1, 10, 77), (1, 3, 55)], "user_id long, ts long, zip int")
    for closed, at in (("left", 55), ("right", 77)):
        for bucket in (None, 4):
            got = asof.asof_join(views, updates, "user_id", "zip", closed, 10000, bucket)
            assert {(r.user_id, r.ts): r.zip for r in got.collect()} == {(1, 10): at, (1, 9): 55, (2, 10): 10000}
    nexts = asof.forward_asof_join(frame(spark, [(1, 1), (1, 4), (1, 11)], "user_id long, ts long"), updates, "user_id", "zip")
    assert {(r.ts, r.zip) for r in nexts.collect()} == {(1, 55), (4, 77)}


def test_both_ways_to_markers_agree(spark):
    rng = random.Random(2)
    e = frame(spark, [(i, rng.randrange(1000)) for i in range(500)], "id long, ts long")
    m = clock.marker_times(marks(spark, [rng.randrange(1000) for _ in range(20)]))
    for closed in ("left", "right"):
        a = {r.id: (r.marker, r.previous) for r in clock.assign_marker(e, m, closed=closed).collect()}
        b = {r.id: (r.marker, r.previous) for r in clock._by_bucket(e, m, "ts", closed).collect()}
        assert a == b


def test_no_markers_and_no_events(spark):
    v = frame(spark, VALUES, "source int, ts long, val long")
    assert barrier.barrier_window_sum(v, marks(spark, [])).count() == 0
    assert ordered(barrier.barrier_window_sum(v.limit(0), marks(spark, [3, 4])), "total") == [(0,), (0,)]
    assert barrier.window_all(v.limit(0), F.sum("val").alias("s")).count() == 0


def test_net_running_max_in_chunks(spark):
    rng = random.Random(3)
    rows = [(t, t, rng.choice([1, -1])) for t in range(1, 400)]
    df, want, run, top = frame(spark, rows, "ts long, seq long, delta long"), {}, 0, 0
    for t, _, d in rows:
        if t % 100 == 0:
            want[t], run, top = top, 0, 0
        run += d
        top = max(top, run)
    got = keyed.net_running_max(df, marks(spark, [100, 200, 300]), 7)
    assert {r.marker: r.high for r in got.collect()} == want


def test_load_summaries_keep_known_keys(spark):
    rows = [(1, 1, 1, 5, 2.0), (1, 1, 1, 6, 4.0), (2, 3, 9, 15, 8.0)]
    df = frame(spark, rows, "house int, household int, plug int, ts long, val double")
    got = {(r.marker, r.house, r.household, r.plug): (r.total, r.n) for r in load.load_summaries(df, marks(spark, [10, 20, 30])).collect()}
    assert got[(10, None, None, None)] == (6.0, 2) and got[(20, None, None, None)] == (8.0, 1)
    assert got[(20, 1, 1, 1)] == (0.0, 0) and got[(30, 2, 3, 9)] == (0.0, 0) and (10, 2, None, None) not in got
    house = {(r.marker, r.house): r.prediction for r in load.predict_house(df, marks(spark, [10, 20])).collect()}
    assert math.isclose(house[(10, 1)], 3.0)


# Recorded loads (id, seconds, watts, property, plug, household, house) of two houses.
LOADS = """
2,1377986401,19.927,1,11,0,0
4,1377986401,9.472,1,2,0,0
5,1377986401,0,1,3,0,0
8,1377986401,17.743,1,7,0,0
9,1377986401,0,1,9,0,0
12,1377986401,21.254,1,0,1,0
13,1377986401,0,1,1,1,0
15,1377986401,0,1,10,1,0
17,1377986401,0,1,12,1,0
20,1377986401,33.291,1,2,1,0
22,1377986401,18.033,1,4,1,0
23,1377986401,0,1,6,1,0
25,1377986401,0,1,0,10,0
27,1377986401,0,1,0,11,0
30,1377986401,17.367,1,2,11,0
31,1377986401,0,1,1,12,0
33,1377986401,0,1,4,12,0
36,1377986401,0,1,10,13,0
38,1377986401,15.737,1,11,13,0
39,1377986401,0,1,2,13,0
41,1377986401,0,1,4,13,0
44,1377986401,20.34,1,5,13,0
45,1377986401,0,1,9,13,0
48,1377986401,0,1,0,2,0
49,1377986401,0,1,1,2,0
52,1377986401,0,1,3,2,0
53,1377986401,0,1,4,2,0
55,1377986401,0,1,6,2,0
58,1377986401,40.356,1,0,3,0
60,1377986401,14.593,1,3,3,0
61,1377986401,0,1,0,4,0
63,1377986401,0,1,2,4,0
65,1377986401,0,1,0,5,0
67,1377986401,0,1,1,5,0
69,1377986401,0,1,2,5,0
71,1377986401,0,1,1,6,0
74,1377986401,30.748,1,11,6,0
75,1377986401,0,1,12,6,0
78,1377986401,10.977,1,2,6,0
80,1377986401,69.812,1,4,6,0
82,1377986401,6.147,1,5,6,0
83,1377986401,0,1,8,6,0
85,1377986401,0,1,9,6,0
87,1377986401,0,1,1,7,0
89,1377986401,0,1,2,7,0
91,1377986401,0,1,4,7,0
94,1377986401,16.308,1,6,7,0
96,1377986401,31.633,1,7,7,0
97,1377986401,0,1,8,7,0
100,1377986401,9.8,1,0,8,0
101,1377986401,0,1,2,8,0
103,1377986401,0,1,3,8,0
105,1377986401,0,1,5,8,0
108,1377986401,0,1,8,8,0
110,1377986401,39.344,1,9,8,0
112,1377986401,0,1,0,9,0
113,1377986401,0,1,10,9,0
116,1377986401,0,1,12,9,0
117,1377986401,0,1,2,9,0
120,1377986401,0,1,3,9,0
121,1377986401,0,1,4,9,0
124,1377986401,0,1,5,9,0
126,1377986401,0,1,6,9,0
127,1377986401,0,1,9,9,0
2450,1377986402,0,1,1,1,0
2451,1377986402,0,1,11,1,0
2454,1377986402,0,1,6,1,0
2456,1377986402,0,1,0,10,0
2458,1377986402,0,1,1,12,0
2459,1377986402,0,1,6,13,0
2461,1377986402,0,1,8,13,0
2464,1377986402,0,1,9,13,0
2466,1377986402,0,1,1,2,0
2468,1377986402,0,1,6,2,0
2469,1377986402,0,1,1,4,0
2472,1377986402,0,1,12,6,0
2473,1377986402,0,1,3,6,0
2476,1377986402,0,1,8,7,0
2478,1377986402,0,1,10,9,0
2480,1377986402,0,1,9,9,0
129,1377986401,0,1,1,1,1
131,1377986401,0,1,2,1,1
133,1377986401,0,1,1,2,1
136,1377986401,16.456,1,4,2,1
2482,1377986402,0,1,2,1,1
"""

# Published sums and counts of two slices (total, n, total so far, n so far), by house and household; a
# household is household and plug number of the record.
SLICE_1 = """
- - 459.3379999999999 68 459.3379999999999 68
0 - 442.88199999999995 64 442.88199999999995 64
1 - 16.456 4 16.456 4
0 0 47.141999999999996 5 47.141999999999996 5
0 1 72.578 7 72.578 7
0 2 0.0 5 0.0 5
0 3 54.949 2 54.949 2
0 4 0.0 2 0.0 2
0 5 0.0 3 0.0 3
0 6 117.68400000000001 8 117.68400000000001 8
0 7 47.941 6 47.941 6
0 8 49.144000000000005 6 49.144000000000005 6
0 9 0.0 9 0.0 9
0 10 0.0 1 0.0 1
0 11 17.367 2 17.367 2
0 12 0.0 2 0.0 2
0 13 36.077 6 36.077 6
1 1 0.0 2 0.0 2
1 2 16.456 2 16.456 2
"""
SLICE_2 = """
- - 0.0 17 459.3379999999999 85
0 - 0.0 16 442.88199999999995 80
1 - 0.0 1 16.456 5
0 0 0.0 0 47.141999999999996 5
0 1 0.0 3 72.578 10
0 2 0.0 2 0.0 7
0 3 0.0 0 54.949 2
0 4 0.0 1 0.0 3
0 5 0.0 0 0.0 3
0 6 0.0 2 117.68400000000001 10
0 7 0.0 1 47.941 7
0 8 0.0 0 49.144000000000005 6
0 9 0.0 2 0.0 11
0 10 0.0 1 0.0 2
0 11 0.0 0 17.367 2
0 12 0.0 1 0.0 3
0 13 0.0 3 36.077 9
1 1 0.0 1 0.0 3
1 2 0.0 0 16.456 2
"""


def test_recorded_loads(spark, tmp_path):
    """Slices end half a second after each second; the recorded job took the hour of day from milliseconds as if they
    were nanoseconds, so that every row is of hour 0."""
    (tmp_path / "loads.csv").write_text(LOADS.strip() + "\n")
    rows = io.read_measurements(spark, f"file://{tmp_path}/loads.csv").filter("kind = 'load'")
    slices = marks(spark, [1377986401500, 1377986402500])
    now = {(r.marker, r.house, r.household): (r.total, r.n) for r in load.load_summaries(rows, slices, "ns").filter("plug is null").collect()}
    hours = load.load_by_hour(rows, slices, "ns").filter("plug is null").collect()
    assert {r.hour for r in hours} == {0}
    past = {}
    for r in sorted(hours, key=lambda r: r.marker):
        past[(r.marker, r.house, r.household)] = (r.total, r.n)
    number = lambda t: None if t == "-" else int(t)
    checked = 0
    for marker, told in ((1377986401500, SLICE_1), (1377986402500, SLICE_2)):
        for line in told.strip().split("\n"):
            house, household, total, n, total_so_far, n_so_far = line.split()
            key = (marker, number(house), number(household))
            so_far = past.get(key) or past[(1377986401500, *key[1:])]  # a row where an hour's sums change
            assert now[key][1] == int(n) and so_far[1] == int(n_so_far)
            assert math.isclose(now[key][0], float(total), rel_tol=1e-9, abs_tol=1e-12)
            assert math.isclose(so_far[0], float(total_so_far), rel_tol=1e-9, abs_tol=1e-12)
            checked += 1
    assert checked == len(now) == 38
