"""Registered queries take every row of their tables."""

from bisect import bisect_right

from tests.conftest import SMALL
from tidemark.plans import events, registry


def test_every_signup_is_a_marker(spark):
    rows = events.events(spark, SMALL).select("ts", "event_type", "val").collect()
    line = sorted({r.ts for r in rows if r.event_type == "signup"})
    want = dict.fromkeys(line, 0)
    for r in rows:
        k = bisect_right(line, r.ts)
        if r.event_type != "signup" and k < len(line):
            want[line[k]] += r.val
    got = {r.marker: r.total for r in registry.QUERIES["barrier_window_sum"](spark, SMALL).collect()}
    assert len(line) > 100 and got == want
    streamed = {r.marker: r.total for r in registry.QUERIES["stream_barrier_sum"](spark, SMALL).collect()}
    assert streamed and streamed == {m: want[m] for m in line if m // 1000 < line[-1] // 1000}


def test_itemsets_of_every_row(spark):
    items = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    got = {r.row for r in registry.QUERIES["match_itemsets"](spark, SMALL).select("row").distinct().collect()}
    assert got == set(range(items))


def test_averages_of_every_level(spark):
    got = registry.QUERIES["load_averages"](spark, SMALL).select("house", "household", "plug").distinct().collect()
    levels = {tuple(c is not None for c in r) for r in got}
    assert levels == {(False, False, False), (True, False, False), (True, True, False), (True, True, True)}
    users = events.values(events.events(spark, SMALL)).select("user_id").distinct().count()
    assert len({r.plug for r in got if r.plug is not None}) == users
