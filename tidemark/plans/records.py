"""Queries of the outlier, log, generator, preparation, source and streaming operators, with their DuckDB SQL."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..operators import keyed, meter, outlier
from ..sources import generate, io, prepare
from ..sources.shared import shared_dir
from ..streaming import stream
from . import events as ev

Q, O = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


_LINE = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


def connections(spark, sf):
    """Line items, numbered in the order of all their columns, as rows of three categories and four whole numbers."""
    rows = prepare.with_row_index(table(spark, sf, "lineitem").select(*_LINE), *_LINE, name="row")
    return rows.select(
        "row",
        F.floor(F.log2(F.col("l_orderkey") + 1)).alias("batch"),
        F.pmod("l_orderkey", F.lit(4)).cast("int").alias("source"),
        F.array("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("cats"),
        F.array("l_quantity", F.round("l_extendedprice"), F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)).alias("x"),
    )


_C = f"""c AS (SELECT row_number() OVER (ORDER BY {", ".join(_LINE)}) - 1 AS row, CAST(l_orderkey % 4 AS INTEGER) AS source,
  l_returnflag AS f1, l_linestatus AS f2, CAST(l_linenumber AS VARCHAR) AS f3,
  l_quantity AS x0, round(l_extendedprice) AS x1, round(l_discount * 100) AS x2, round(l_tax * 100) AS x3 FROM lineitem),
i AS (SELECT row, source, x0, x1, x2, x3, unnest(list_distinct([[f1], [f2], [f3], [f1, f2], [f1, f3], [f2, f3]])) AS itemset FROM c)"""
_CELLS = [(i, j) for i in range(4) for j in range(i, 4)]


@query("itemset_lattice", f"WITH {_C}, d AS (SELECT DISTINCT 0 AS f, f1 AS v FROM c UNION SELECT DISTINCT 1, f2 FROM c UNION SELECT DISTINCT 2, f3 FROM c) SELECT DISTINCT array_to_string(itemset, ',') AS itemset FROM (SELECT [v] AS itemset FROM d UNION ALL SELECT [a.v, b.v] FROM d a JOIN d b ON a.f < b.f)")
def _(spark, sf):
    cats = connections(spark, sf).select(F.posexplode("cats").alias("feature", "value")).distinct()
    return outlier.itemset_lattice(cats).select(F.array_join("itemset", ",").alias("itemset"))


@query("match_itemsets", f"WITH {_C} SELECT row, array_to_string(itemset, ',') AS itemset FROM i")
def _(spark, sf):
    rows = outlier.match_itemsets(connections(spark, sf), 3)
    return rows.select("row", F.array_join("itemset", ",").alias("itemset"))


@query("itemset_support", f"WITH {_C} SELECT array_to_string(itemset, ',') AS itemset, count(*) AS n FROM i GROUP BY 1")
def _(spark, sf):
    return outlier.itemset_support(connections(spark, sf), 3).select(F.array_join("itemset", ",").alias("itemset"), "n")


def _listed(cell) -> str:
    return "[" + ", ".join(cell(min(i, j), max(i, j)) for i in range(4) for j in range(4)) + "]"


_MOMENTS = f"""WITH {_C}, m AS (SELECT array_to_string(itemset, ',') AS itemset, count(*) AS n,
  {", ".join(f"CAST(sum(x{i}) AS BIGINT) AS l{i}" for i in range(4))}, {", ".join(f"CAST(sum(x{i} * x{j}) AS BIGINT) AS s{i}{j}" for i, j in _CELLS)}
  FROM i GROUP BY 1)"""
_WHOLE = f"SELECT itemset, n, array_to_string([l0, l1, l2, l3], ' ') AS l, array_to_string({_listed(lambda i, j: f's{i}{j}')}, ' ') AS s FROM m"


def _all_sums(moments):
    whole = lambda c: F.array_join(F.transform(c, lambda v: F.round(v).cast("long").cast("string")), " ").alias(c)
    return moments.select(F.array_join("itemset", ",").alias("itemset"), "n", whole("l"), whole("s"))


@query("itemset_moments", f"{_MOMENTS} {_WHOLE}")
def _(spark, sf):
    return _all_sums(outlier.itemset_moments(connections(spark, sf), 3))


def _covariances(spark, sf, textbook):
    m = outlier.itemset_covariance(outlier.itemset_moments(connections(spark, sf), 3), textbook=textbook)
    cells = m.select(F.array_join("itemset", ",").alias("itemset"), F.posexplode("c").alias("cell", "value"))
    return cells.select("itemset", "cell", F.round("value", 3).alias("value"))


def _covariance_sql(sign: str) -> str:
    one = f"CASE WHEN n <= 1 THEN s::DOUBLE {sign} la::DOUBLE * lb ELSE s / (n - 1.0) {sign} la::DOUBLE * lb / (n * (n - 1.0)) END"
    cells = " UNION ALL ".join(f"SELECT itemset, n, {4 * i + j} AS cell, s{min(i, j)}{max(i, j)} AS s, l{i} AS la, l{j} AS lb FROM m" for i in range(4) for j in range(4))
    return f"{_MOMENTS} SELECT itemset, CAST(cell AS INTEGER) AS cell, round({one}, 3) AS value FROM ({cells})"


@query("itemset_covariance", _covariance_sql("+"))
def _(spark, sf):
    return _covariances(spark, sf, False)


@query("itemset_covariance_textbook", _covariance_sql("-"))
def _(spark, sf):
    return _covariances(spark, sf, True)


@query("merge_moments", f"{_MOMENTS} {_WHOLE}")
def _(spark, sf):
    rows = connections(spark, sf)
    return _all_sums(outlier.merge_moments(*[outlier.itemset_moments(rows.filter(F.col("source") == s), 3) for s in range(4)]))


def _scored_sql(per: str) -> str:
    """Violations along rows with statistics per itemset, and per source where ``per`` says so."""
    w = f"OVER (PARTITION BY {per}itemset ORDER BY row ROWS UNBOUNDED PRECEDING)"
    sums = ", ".join([f"sum(x{i}) {w} AS l{i}" for i in range(4)] + [f"sum(x{i} * x{j}) {w} AS s{i}{j}" for i, j in _CELLS])
    cov = ", ".join(
        f"(x{i} - l{i} / n) * (x{j} - l{j} / n) AS p{i}{j}, CASE WHEN n <= 1 THEN s{i}{j} + l{i} * l{j} ELSE s{i}{j} / (n - 1) + l{i} * l{j} / (n * (n - 1)) END AS c{i}{j}"
        for i, j in _CELLS
    )
    spread = ", ".join(f"sum(p{i}{j} * p{i}{j}) {w} AS vs{i}{j}, sum(p{i}{j}) {w} AS vl{i}{j}" for i, j in _CELLS)
    sigma = ", ".join(
        f"sqrt(greatest((vs{i}{j} + 2 * c{i}{j} * vl{i}{j} + n * c{i}{j} * c{i}{j}) / greatest(n - 1, 1), 0)) AS g{i}{j}" for i, j in _CELLS
    )
    v = " + ".join(f"CASE WHEN abs(p{i}{j} - c{i}{j}) > 1.96 * g{i}{j} AND g{i}{j} > 0 THEN {1 if i == j else 2} ELSE 0 END" for i, j in _CELLS)
    return f"""{_C}, k AS (SELECT *, count(*) {w}::DOUBLE AS n, {sums} FROM i), q AS (SELECT *, {cov} FROM k), t AS (SELECT *, {spread} FROM q),
u AS (SELECT *, {sigma} FROM t), scored AS (SELECT row, source, itemset, CASE WHEN n < 10 OR {v} > 4.8 THEN 1.0::DOUBLE / len(itemset) ELSE 0.0::DOUBLE END AS contribution FROM u)"""


@query("violation_scores", f"WITH {_scored_sql('')} SELECT row, array_to_string(itemset, ',') AS itemset, contribution FROM scored")
def _(spark, sf):
    v = outlier.violation_scores(connections(spark, sf), 3)
    return v.select("row", F.array_join("itemset", ",").alias("itemset"), "contribution")


@query("anomaly_score", f"WITH {_scored_sql('')} SELECT row, sum(contribution) AS score FROM scored GROUP BY row")
def _(spark, sf):
    return outlier.row_scores(connections(spark, sf), 3)


def wide_connections(spark, sf):
    """Parts as rows of two categories and 34 whole numbers, as many as a recorded connection has."""
    price = F.round("p_retailprice").cast("long")
    number = lambda k: F.pmod(F.col("p_partkey") * (2 * k + 1) + price + F.col("p_size") * k, F.lit(11 + k)).cast("double")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("row"), F.array("p_type", "p_brand").alias("cats"), F.array(*map(number, range(34))).alias("x"))


def _wide_sql() -> str:
    """The same statistics in long form: one row an itemset and pair of features."""
    w = "OVER (PARTITION BY itemset, a, b ORDER BY row ROWS UNBOUNDED PRECEDING)"
    return f"""WITH c AS (SELECT p_partkey AS row, p_type AS f1, p_brand AS f2,
  [CAST((p_partkey * (2 * k + 1) + CAST(round(p_retailprice) AS BIGINT) + p_size * k) % (11 + k) AS DOUBLE) for k in range(34)] AS x FROM part),
i AS (SELECT row, x, unnest([[f1], [f2], [f1, f2]]) AS itemset FROM c),
p AS (SELECT a.k AS a, b.k AS b FROM range(1, 35) a(k), range(1, 35) b(k) WHERE a.k <= b.k),
j AS (SELECT row, itemset, a, b, x[a] AS xa, x[b] AS xb FROM i, p),
k AS (SELECT *, count(*) {w}::DOUBLE AS n, sum(xa) {w} AS la, sum(xb) {w} AS lb, sum(xa * xb) {w} AS s FROM j),
q AS (SELECT *, (xa - la / n) * (xb - lb / n) AS v, CASE WHEN n <= 1 THEN s + la * lb ELSE s / (n - 1) + la * lb / (n * (n - 1)) END AS c FROM k),
t AS (SELECT *, sum(v * v) {w} AS vs, sum(v) {w} AS vl FROM q),
u AS (SELECT *, sqrt(greatest((vs + 2 * c * vl + n * c * c) / greatest(n - 1, 1), 0)) AS g FROM t),
r AS (SELECT row, itemset, max(n) AS n, sum(CASE WHEN abs(v - c) > 1.96 * g AND g > 0 THEN CASE WHEN a = b THEN 1 ELSE 2 END ELSE 0 END) AS far FROM u GROUP BY row, itemset)
SELECT row, sum(CASE WHEN n < 10 OR far > 0.3 * 34 * 34 THEN 1.0::DOUBLE / len(itemset) ELSE 0.0::DOUBLE END) AS score FROM r GROUP BY row"""


@query("anomaly_score_wide", _wide_sql())
def _(spark, sf):
    return outlier.row_scores(wide_connections(spark, sf), 2)


def _flags(rows):
    """Local scores: every source has a model of its own."""
    return outlier.flag_outliers(outlier.row_scores(rows, 3, by="source"))


_F = """sc AS (SELECT source, row, sum(contribution) AS score, row_number() OVER (PARTITION BY source ORDER BY row) AS k FROM scored GROUP BY source, row),
f AS (SELECT source, k, row, score, 0.0::DOUBLE AS bound, score > 0 AS outlier, CASE WHEN score > 0 THEN []::DOUBLE[] ELSE [score] END AS normal FROM sc WHERE k = 1
UNION ALL SELECT source, k, row, score, bound, score > bound, CASE WHEN score > bound THEN normal ELSE list_append(normal, score)[-40:] END
FROM (SELECT sc.source, sc.k, sc.row, sc.score, f.normal, coalesce(10 * (list_sum(f.normal) / len(f.normal)), 0.0) AS bound FROM f JOIN sc ON sc.source = f.source AND sc.k = f.k + 1))"""


@query("flag_outliers", f"WITH RECURSIVE {_scored_sql('source, ')}, {_F} SELECT source, row, score, bound, outlier FROM f")
def _(spark, sf):
    return _flags(connections(spark, sf)).drop("after")


def _confirmed_sql() -> str:
    """Local outliers of a check against the sum of all sources' statistics at its marker, each counted once more."""
    names = [f"l{i}" for i in range(4)] + [f"{x}{i}{j}" for x in ("s", "vs", "vl") for i, j in _CELLS]
    last = ", ".join(f"arg_max({c}, t.row) AS {c}" for c in ("n", *names))
    whole = ", ".join(f"sum({c}) AS {c}" for c in ("n", *names))
    more = ", ".join([f"l{i} + x{i} AS l{i}" for i in range(4)] + [f"s{i}{j} + x{i} * x{j} AS s{i}{j}" for i, j in _CELLS])
    cov = ", ".join(
        f"(x{i} - l{i} / n) * (x{j} - l{j} / n) AS p{i}{j}, CASE WHEN n <= 1 THEN s{i}{j} + l{i} * l{j} ELSE s{i}{j} / (n - 1) + l{i} * l{j} / (n * (n - 1)) END AS c{i}{j}"
        for i, j in _CELLS
    )
    sigma = ", ".join(
        f"sqrt(greatest((vs{i}{j} + p{i}{j} * p{i}{j} + 2 * c{i}{j} * (vl{i}{j} + p{i}{j}) + n * c{i}{j} * c{i}{j}) / greatest(n - 1, 1), 0)) AS g{i}{j}" for i, j in _CELLS
    )
    far = " + ".join(f"CASE WHEN abs(p{i}{j} - c{i}{j}) > 1.96 * g{i}{j} AND g{i}{j} > 0 THEN {1 if i == j else 2} ELSE 0 END" for i, j in _CELLS)
    keep = ", ".join(f"{x}{i}{j}" for x in ("vs", "vl") for i, j in _CELLS)
    xs = "x0, x1, x2, x3"
    return f"""WITH RECURSIVE {_scored_sql("source, ")}, {_F},
mk AS (SELECT max(row) + 1 AS m FROM (SELECT row_number() OVER (ORDER BY {", ".join(_LINE)}) - 1 AS row, floor(log2(l_orderkey + 1)) AS batch FROM lineitem) GROUP BY batch),
w AS (SELECT f.*, coalesce(10 * (list_sum(normal) / len(normal)), 0.0) AS after, (SELECT min(m) FROM mk WHERE m > f.row) AS m FROM f),
bo AS (SELECT m, after AS bound FROM w QUALIFY row_number() OVER (PARTITION BY m ORDER BY source, row DESC) = 1),
fo AS (SELECT w.m, i.row, i.itemset, {xs} FROM w JOIN i USING (row) WHERE w.outlier AND w.m IS NOT NULL),
st AS (SELECT m, source, itemset, {last} FROM t JOIN mk ON t.row < mk.m WHERE itemset IN (SELECT itemset FROM fo) GROUP BY m, source, itemset),
md AS (SELECT m, itemset, {whole} FROM st GROUP BY m, itemset),
j1 AS (SELECT fo.m, fo.row, fo.itemset, {xs}, n + 1 AS n, {more}, {keep} FROM fo JOIN md USING (m, itemset)),
j2 AS (SELECT *, {cov} FROM j1), j3 AS (SELECT *, {sigma} FROM j2),
j4 AS (SELECT m, row, sum(CASE WHEN n < 10 OR {far} > 4.8 THEN 1.0::DOUBLE / len(itemset) ELSE 0.0::DOUBLE END) AS score FROM j3 GROUP BY m, row)
SELECT m AS marker, row, score, bound FROM j4 JOIN bo USING (m) WHERE score > bound"""


@query("confirm_outliers", _confirmed_sql())
def _(spark, sf):
    rows = connections(spark, sf)
    markers = rows.groupBy("batch").agg((F.max("row") + 1).alias("ts")).select("ts")  # checks at orders that double
    return outlier.confirm_outliers(_flags(rows), rows, markers, 3)


def _logs(spark, sf):
    ns = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000
    produced = table(spark, sf, "orders").select(F.col("o_orderkey").alias("message"), ns("o_orderdate").alias("ts_ns"), "o_orderpriority")
    consumed = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("message"), ns("l_shipdate").alias("ts_ns"))
    return produced, consumed


_L = """pr AS (SELECT o_orderkey AS message, epoch_us(o_orderdate) AS p, o_orderpriority FROM orders),
co AS (SELECT l_orderkey AS message, max(epoch_us(l_shipdate)) AS ts FROM lineitem GROUP BY 1),
l AS (SELECT message, ts, (ts - p) / 1000.0 AS latency, o_orderpriority AS g FROM pr JOIN co USING (message))"""


def _latency(spark, sf):
    produced, consumed = _logs(spark, sf)
    return meter.event_latency(produced, consumed).join(produced.select("message", F.col("o_orderpriority").alias("g")), "message")


@query("event_latency", f"WITH {_L} SELECT message, ts * 1000 AS ts, latency::DOUBLE AS latency, ((ts - (SELECT min(ts) FROM l)) / 1000.0)::DOUBLE AS elapsed FROM l")
def _(spark, sf):
    return meter.event_latency(*_logs(spark, sf))


@query("unmatched", "SELECT o_orderkey AS message FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def _(spark, sf):
    produced = table(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("message"))
    return meter.unmatched(produced, table(spark, sf, "orders").select(F.col("o_orderkey").alias("message")))


@query("latency_percentiles", f"WITH {_L} SELECT g, round(quantile_cont(latency, 0.1), 3)::DOUBLE AS p10, round(quantile_cont(latency, 0.5), 3)::DOUBLE AS p50, round(quantile_cont(latency, 0.9), 3)::DOUBLE AS p90 FROM l GROUP BY g")
def _(spark, sf):
    rows = meter.latency_percentiles(_latency(spark, sf), "g")
    return rows.select("g", *[F.round(c, 3).alias(c) for c in ("p10", "p50", "p90")])


@query("latency_cdf", f"WITH {_L} SELECT g, latency::DOUBLE AS latency, round((row_number() OVER (PARTITION BY g ORDER BY latency) - 1) / count(*) OVER (PARTITION BY g), 9) AS share FROM l")
def _(spark, sf):
    return meter.latency_cdf(_latency(spark, sf), "g").withColumn("share", F.round("share", 9))


def _runs(spark, sf):
    e = ev.events(spark, sf)
    ends = e.groupBy("source", "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("events"))
    return ends.select("source", "event_type", (F.col("a") * 1000).alias("start_ns"), (F.col("b") * 1000).alias("end_ns"), "events")


_R = f"WITH {ev.BASE}, r AS (SELECT source, count(*) AS events, (max(ts) - min(ts)) / 1000.0 AS ms FROM e GROUP BY source)"


@query("throughput", f"{_R} SELECT source, events, round(events / ms, 12)::DOUBLE AS per_ms, CAST(floor(events / ms) AS BIGINT) AS floor_per_ms FROM r")
def _(spark, sf):
    return meter.throughput(_runs(spark, sf), "source").withColumn("per_ms", F.round("per_ms", 12))


@query("max_throughput", f"{_R} SELECT c.source, coalesce(round(max(events / ms) * 1e6, 3), 0.0)::DOUBLE AS best FROM (SELECT DISTINCT user_id % 5 AS source FROM events) c LEFT JOIN r ON r.source = c.source GROUP BY 1")
def _(spark, sf):
    configs = table(spark, sf, "events").select((F.col("user_id") % 5).alias("source"))
    rates = meter.throughput(_runs(spark, sf), "source").withColumn("source", F.col("source").cast("long"))
    return meter.max_throughput(rates, configs, "source").select("source", F.round(F.col("best") * 1e6, 3).alias("best"))


@query("speedup", f"{_R} SELECT source, round((events / ms) / (SELECT events / ms FROM r WHERE source = 0), 6)::DOUBLE AS ratio FROM r")
def _(spark, sf):
    rates = meter.throughput(_runs(spark, sf), "source")
    best = meter.max_throughput(rates, rates.select("source"), "source")
    return meter.speedup(best, 0, "source").select("source", F.round("ratio", 6).alias("ratio"))


_S = f"""WITH {ev.BASE}, per AS (SELECT ts // 3600000000 * 3600000000000 AS ts, count(*) AS n FROM e GROUP BY 1),
steps AS (SELECT * FROM (SELECT ts, n / ((ts - lag(ts) OVER (ORDER BY ts)) / 1e6) AS rate FROM per) WHERE rate IS NOT NULL),
z AS (SELECT min(ts) AS a, max(ts) AS b, count(*) * 3 AS k FROM per),
g AS (SELECT a + i * ((b - a) / (k - 1)) AS ts FROM z, range((SELECT k FROM z)) r(i)),
near AS (SELECT g.ts, s.ts::DOUBLE AS t0, s.rate AS r0, u.ts::DOUBLE AS t1, u.rate AS r1 FROM g
  ASOF LEFT JOIN steps s ON g.ts >= s.ts::DOUBLE ASOF LEFT JOIN steps u ON g.ts <= u.ts::DOUBLE)"""


@query("throughput_series", f"{_S} SELECT CAST(round(ts / 1e6) AS BIGINT) AS ts_ms, round(CASE WHEN t0 IS NULL THEN r1 WHEN t1 IS NULL OR t1 = t0 THEN r0 ELSE r0 + (ts - t0) / (t1 - t0) * (r1 - r0) END * 1e9, 3) AS rate FROM near")
def _(spark, sf):
    e = ev.events(spark, sf).withColumn("ts_ns", F.floor(F.col("ts") / 3_600_000_000) * 3_600_000_000_000)
    rows = meter.throughput_series(e.groupBy("ts_ns").agg(F.count("*").alias("n")))
    return rows.select(F.round(F.col("ts") / 1e6).cast("long").alias("ts_ms"), F.round(F.col("rate") * 1e9, 3).alias("rate"))


@query("run_meter", f"WITH {_L} SELECT count(*) AS volume, round(avg(latency), 3)::DOUBLE AS mean_latency, ((max(ts) - (SELECT min(p) FROM pr)) // 1000)::BIGINT AS completion FROM l")
def _(spark, sf):
    produced, consumed = _logs(spark, sf)
    got = meter.event_latency(produced, consumed).withColumn("ts", F.floor(F.col("ts") / 1_000_000))
    sent = produced.join(consumed.select("message").distinct(), "message", "left_semi").withColumn("ts", F.floor(F.col("ts_ns") / 1_000_000))
    base = produced.agg(F.min(F.floor(F.col("ts_ns") / 1_000_000)).alias("t0"))
    out = meter.run_meter(sent, got).join(got.agg(F.max("ts").alias("t1"))).join(base)
    return out.select("volume", F.round("mean_latency", 3).alias("mean_latency"), (F.col("t1") - F.col("t0")).alias("completion"))


@query("messages_per_interval", "SELECT user_id % 4 AS node, time_bucket(INTERVAL '6 hours', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    log = table(spark, sf, "events").select((F.col("user_id") % 4).alias("node"), F.col("ts").cast("timestamp").alias("ts"))
    return meter.messages_per_interval(log, "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


# Generated streams take their steps from the places of the events.
def _places(spark, sf):
    rows = prepare.with_row_index(table(spark, sf, "events").select("event_id"), "event_id", name="id")
    return {"n": rows.count(), "ids": rows}


_PLACES = "(SELECT row_number() OVER (ORDER BY event_id) - 1 AS t FROM events)"


@query("gen_values", f"SELECT CAST(s AS INTEGER) AS source, t AS ts, t + 1 AS val FROM range(4) a(s), {_PLACES}")
def _(spark, sf):
    return generate.gen_values(spark, sources=4, **_places(spark, sf))


@query("gen_barriers", f"SELECT (t + 1) * 10 // 5 - 1 AS ts, (t + 1) % 5 <> 0 AS is_heartbeat FROM {_PLACES} WHERE t < (SELECT count(*) // 10 * 5 FROM events) UNION ALL SELECT count(*), true FROM events")
def _(spark, sf):
    return generate.gen_barriers(spark, ratio=10, heartbeats=5, **_places(spark, sf))


@query("gen_page_views", f"SELECT u AS user_id, t AS ts, 'view' AS kind FROM range(2) a(u), {_PLACES} UNION ALL SELECT NULL, t, 'heartbeat' FROM {_PLACES} WHERE t % 100 = 0")
def _(spark, sf):
    return generate.gen_page_views(spark, users=2, **_places(spark, sf))


@query("gen_get_update", f"SELECT u AS user_id, t + CASE WHEN t % 1000 = 0 THEN 1 ELSE 99 END AS ts, CASE WHEN t % 1000 = 0 THEN 'get' ELSE 'update' END AS kind, t % 1000 <> 0 AS has_zip FROM range(2) a(u), {_PLACES} WHERE t % 1000 = 0 OR t % 10000 = 9900")
def _(spark, sf):
    made = generate.gen_get_update(spark, users=2, **_places(spark, sf))
    return made.select("user_id", "ts", "kind", F.coalesce(F.col("zip").between(10000, 99999), F.lit(False)).alias("has_zip"))


@query("gen_rate", f"SELECT t AS seq, (t + 1) / (1 / 2.0) AS ts FROM {_PLACES} WHERE t < (SELECT count(*) // 2 FROM events)")
def _(spark, sf):
    places = _places(spark, sf)
    return generate.gen_rate(spark, places["n"], 2.0, ids=places["ids"])


_A = "(SELECT 0.5::DOUBLE / count(*) AS a, count(*)::DOUBLE AS n FROM events)"


@query("gen_rate_accelerated", f"SELECT t AS seq, round((sqrt(0.25::DOUBLE * 0.25 + 2 * a * (t + 1)) - 0.25) / a, 6) AS ts FROM {_PLACES}, {_A} WHERE t < floor(n / 4 + a / 2 * n * n)")
def _(spark, sf):
    places = _places(spark, sf)
    made = generate.gen_rate(spark, places["n"], 4.0, 0.5 / places["n"], ids=places["ids"])
    return made.select("seq", F.round("ts", 6).alias("ts"))


@query(
    "interleave_heartbeats",
    f"WITH {ev.BASE}, m AS (SELECT DISTINCT ts // 60000000 AS ts FROM e), g AS (SELECT {ev.START} // 60000000 + i * 7 AS ts FROM range({30 * 1440 // 7 + 1}) t(i) WHERE i * 7 < {30 * 1440}) SELECT ts, false AS is_heartbeat FROM m UNION ALL SELECT ts, true FROM g WHERE ts NOT IN (SELECT ts FROM m)",
)
def _(spark, sf):
    minutes = ev.events(spark, sf).select(F.floor(F.col("ts") / 60_000_000).alias("ts")).distinct()
    begin = ev.START // 60_000_000
    return generate.interleave_heartbeats(minutes, 7, begin, begin + 30 * 1440)


@query("split_by", "SELECT user_id % 4 AS house, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    path = shared_dir(spark, "split-by")
    prepare.split_by(table(spark, sf, "events").withColumn("house", F.col("user_id") % 4), path, "house", "event_type")
    back = spark.read.parquet(path).groupBy(F.col("house").cast("long").alias("house"), "event_type")
    return back.agg(F.count("*").alias("n"))


_ROW = "(row_number() OVER (ORDER BY o_orderkey) - 1)"


@query("split_round_robin", f"SELECT *, CAST({_ROW} % 7 AS INTEGER) AS part FROM orders")
def _(spark, sf):
    return prepare.split_round_robin(table(spark, sf, "orders"), 7, "o_orderkey")


@query("split_contiguous", f"SELECT *, CAST({_ROW} // (SELECT CAST(ceil(count(*) / 7.0) AS BIGINT) FROM orders) AS INTEGER) AS part FROM orders")
def _(spark, sf):
    return prepare.split_contiguous(table(spark, sf, "orders"), 7, "o_orderkey")


@query("add_timestamps", f"SELECT *, {_ROW} * 1000 AS ts FROM orders")
def _(spark, sf):
    return prepare.add_timestamps(table(spark, sf, "orders"), "o_orderkey")


@query("cut_before", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10'")
def _(spark, sf):
    e = ev.events(spark, sf)
    return prepare.cut_before(e, ev.START + 9 * ev.DAY).select("event_id")


@query("head", "SELECT event_id FROM events ORDER BY ts LIMIT 100")
def _(spark, sf):
    return prepare.head(ev.events(spark, sf), 100, "ts").select("event_id")


@query("column_domains", "WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS r, * FROM lineitem) SELECT 'l_returnflag' AS \"column\", l_returnflag AS value, count(*) AS n, min(r) AS first_row FROM r GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*), min(r) FROM r GROUP BY 2")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("r", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return prepare.column_domains(rows, ["l_returnflag", "l_linestatus"], "r")


@query("read_measurements", f"WITH {ev.BASE} SELECT event_id AS id, ts // 1000000 * 1000 AS ts, value AS val, CASE WHEN event_type = 'click' THEN 'load' ELSE 'work' END AS kind, CAST(user_id AS INTEGER) AS plug, CAST(user_id // 3 AS INTEGER) AS household, CAST(user_id // 15 AS INTEGER) AS house FROM e")
def _(spark, sf):
    path, e = shared_dir(spark, "measurements"), ev.events(spark, sf)
    flag = F.when(F.col("event_type") == "click", 1).otherwise(0)
    e.select("event_id", F.floor(F.col("ts") / 1_000_000), "value", flag, "user_id", F.floor(F.col("user_id") / 3), F.floor(F.col("user_id") / 15)).write.csv(path)
    return io.read_measurements(spark, path)


@query("read_connections", "SELECT l_orderkey AS ts, l_returnflag || ',' || l_linestatus AS cats, l_quantity + 36 AS total, 'normal' AS label FROM lineitem")
def _(spark, sf):
    path, rows = shared_dir(spark, "connections"), table(spark, sf, "lineitem")
    columns = [F.lit(1.0 if c != "duration" else 0.0) if c not in io.CATEGORIES else F.lit("0") for c in io.CONNECTION]
    fill = {"duration": F.col("l_quantity"), "protocol": F.col("l_returnflag"), "service": F.col("l_linestatus"), "dst_bytes": F.lit(4.0)}
    columns = [fill.get(c, v).alias(f"c{i}") for i, (c, v) in enumerate(zip(io.CONNECTION, columns, strict=True))]
    rows.select("l_orderkey", *columns, F.lit("normal.").alias("label")).write.csv(path)
    back = io.read_connections(spark, path)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return back.select("ts", F.array_join(F.slice("cats", 1, 2), ",").alias("cats"), total.alias("total"), "label")


@query("result_lines", "SELECT '1.5 vals/ms, w' || (event_id % 3) AS config, round(value, 2) AS latency_ms, round(value * 2, 2) AS throughput FROM events")
def _(spark, sf):
    path = shared_dir(spark, "lines")
    line = F.format_string("1.5 vals/ms, w%d, %.2f ms, %.2f events/ms", F.col("event_id") % 3, F.col("value"), F.col("value") * 2)
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return io.parse_result_lines(spark.read.text(path))


@query("write_result_lines", "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') || ' ' || event_id || ' @ ' || user_id || ' [latency: ' || (event_id % 9) || ' ms]' AS value FROM events")
def _(spark, sf):
    path, e = shared_dir(spark, "results"), table(spark, sf, "events")
    rows = e.select(F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("value"), F.col("user_id").alias("ts"), (F.col("event_id") % 9).alias("latency"))
    io.write_result_lines(rows, path)
    return spark.read.text(path)


@query("state_snapshots", ev.sql("SELECT marker, count(*) AS keys, sum(total)::BIGINT AS total FROM d GROUP BY marker", ev._tumble(ev.DAY)))
def _(spark, sf):
    snap = io.state_snapshots(ev.Q["tumbling_sum"](spark, sf))
    total = F.aggregate("state", F.lit(0).cast("long"), lambda a, s: a + s["total"])
    return snap.select("marker", F.size("state").cast("long").alias("keys"), total.alias("total"))


def _totals(spark, sf):
    """Sums of keys that come and go: only windows with events have a row."""
    return keyed.tumbling_sum(ev.values(ev.events(spark, sf)), ev.every(spark, ev.DAY), "user_id", every_key=False)


_T = f"""t AS (SELECT user_id, {ev.START} + ((ts - {ev.START}) // {ev.DAY} + 1) * {ev.DAY} AS marker, sum(val)::BIGINT AS total FROM v GROUP BY ALL),
n AS (SELECT marker, row_number() OVER (ORDER BY marker) AS i, lead(marker) OVER (ORDER BY marker) AS nm FROM (SELECT DISTINCT marker FROM t)),
r AS (SELECT user_id, marker, total, i, nm, lag(i) OVER p AS bi, lag(total) OVER p AS bt, lead(i) OVER p AS ai FROM t JOIN n USING (marker) WINDOW p AS (PARTITION BY user_id ORDER BY marker))"""


@query("state_changes", ev.sql("SELECT marker, user_id, total, false AS gone FROM r WHERE bi IS NULL OR bi < i - 1 OR bt IS DISTINCT FROM total UNION ALL SELECT nm, user_id, total, true FROM r WHERE nm IS NOT NULL AND (ai IS NULL OR ai > i + 1)", _T))
def _(spark, sf):
    return io.state_changes(_totals(spark, sf), "user_id")


@query("states", ev.sql("SELECT marker, user_id, total FROM t", _T))
def _(spark, sf):
    """Every state again from the changes alone."""
    whole = _totals(spark, sf)
    return io.states(io.state_changes(whole, "user_id"), whole, "user_id")


EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark, sf):
    rows = io.replay(spark, sf, EVENT_SCHEMA, glob="events*.parquet")
    return rows.withColumn("val", F.round(F.col("value") * 100).cast("long"))


@contextmanager
def _setting(spark, key, value):
    """A session setting for the time of one stream."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _drained(spark, df, name):
    path = shared_dir(spark, name)
    with _setting(spark, "spark.sql.streaming.multipleWatermarkPolicy", "min"), _setting(spark, *_ROCKS):
        stream.drain(df, f"{path}/out", f"{path}/state")
    return spark.read.schema(df.schema).parquet(f"{path}/out")


_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query("late_rows", "SELECT count(*) AS late FROM events WHERE ts < TIMESTAMP '2024-01-10'")
def _(spark, sf):
    """The events of the month's end come first, so that all of its beginning is behind the watermark. The batch between
    them is there because rows are late by the watermark that the batch before them had."""
    path, e = shared_dir(spark, "late"), table(spark, sf, "events")
    e.filter("ts >= '2024-01-20'").coalesce(1).write.parquet(f"{path}/in")
    e.filter("ts between '2024-01-10' and '2024-01-20'").coalesce(1).write.mode("append").parquet(f"{path}/in")
    e.filter("ts < '2024-01-10'").coalesce(1).write.mode("append").parquet(f"{path}/in")
    rows = io.replay(spark, f"{path}/in", EVENT_SCHEMA).select("ts", "event_id").dropDuplicates(["event_id", "ts"])
    done = stream.drain(rows, f"{path}/out", f"{path}/state")
    return spark.createDataFrame([(stream.late_rows(done),)], "late long")


_MAX = "(SELECT max(ts) FROM events)"


@query("stream_tumbling", f"SELECT epoch_us(date_trunc('day', ts)) + {ev.DAY} AS marker, user_id, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS total FROM events GROUP BY 1, 2 HAVING marker <= epoch_us({_MAX})")
def _(spark, sf):
    out = _drained(spark, stream.stream_tumbling(_stream(spark, sf), "1 day", "user_id"), "tumbling")
    return out.select(F.unix_micros("marker").alias("marker"), "user_id", "total")


@query("stream_sliding", f"WITH {ev.BASE} SELECT m AS marker, source, sum(val)::BIGINT AS total FROM e, (SELECT {ev.START} + i * {ev.HOURS8} AS m FROM range(1, 100) t(i)) WHERE e.ts >= m - {ev.DAY} AND e.ts < m AND m <= (SELECT max(ts) FROM e) GROUP BY 1, 2")
def _(spark, sf):
    rows = _stream(spark, sf).withColumn("source", (F.col("user_id") % 4).cast("int"))
    out = _drained(spark, stream.stream_sliding(rows, "1 day", "8 hours", "source"), "sliding")
    return out.select(F.unix_micros("marker").alias("marker"), "source", "total")


@query("stream_load_summaries", f"SELECT epoch_us(date_trunc('day', ts)) + {ev.DAY} AS marker, user_id // 15 AS house, user_id // 3 AS household, user_id AS plug, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS total, count(*) AS n FROM events GROUP BY GROUPING SETS ((1), (1, 2), (1, 2, 3), (1, 2, 3, 4)) HAVING marker <= epoch_us({_MAX})")
def _(spark, sf):
    rows = _stream(spark, sf).select("ts", "val", F.floor(F.col("user_id") / 15).alias("house"), F.floor(F.col("user_id") / 3).alias("household"), F.col("user_id").alias("plug"))
    out = _drained(spark, stream.stream_load_summaries(rows, "1 day"), "load")
    return out.withColumn("marker", F.unix_micros("marker"))


@query("stream_fraud", f"WITH {ev.BASE}, h AS (SELECT ts // {ev.DAY} AS d, sum(val) AS model FROM e GROUP BY 1) SELECT event_id, val FROM e JOIN h ON e.ts // {ev.DAY} = h.d + 1 WHERE h.model % 100 = val % 100 AND (h.d + 1) * {ev.DAY} <= (SELECT max(ts) FROM e)")
def _(spark, sf):
    rows = _stream(spark, sf).select("ts", "event_id", "val")
    return _drained(spark, stream.stream_fraud(rows, "1 day", 86_400, 100), "fraud").select("event_id", "val")


@query("watermarked", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def _(spark, sf):
    raw = lambda k: _stream_raw(spark, sf).filter(F.col("event_type") == k)
    out = _drained(spark, stream.watermarked(raw("click"), raw("view")).select("event_id", "event_type", "ts"), "merged")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


def _stream_raw(spark, sf):
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events*.parquet")
    return reader.parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_barrier_sum", ev.sql("SELECT marker, total FROM w WHERE marker // 1000 < (SELECT max(ts) // 1000 FROM b)"))
def _(spark, sf):
    rows = _stream(spark, sf)
    own = rows.filter("event_type <> 'signup'").select("ts", "val")
    marks = _stream(spark, sf).filter("event_type = 'signup'").select("ts")
    out = _drained(spark, stream.stream_barrier_sum(own, marks, 4), "barriers")
    return out.groupBy(F.col("marker_us").alias("marker")).agg(F.sum("total").alias("total"))


@query("stream_asof_join", ev.sql("SELECT l.event_id, u.val AS zip FROM (SELECT * FROM e WHERE event_type = 'view') l ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'signup') u ON l.user_id = u.user_id AND l.ts > u.ts WHERE l.ts // 1000 < (SELECT min(m) FROM (SELECT max(ts) // 1000 AS m FROM e WHERE event_type IN ('view', 'signup') GROUP BY event_type))"))
def _(spark, sf):
    views = _stream(spark, sf).filter("event_type = 'view'").select("ts", "user_id", F.col("event_id").alias("id"))
    updates = _stream(spark, sf).filter("event_type = 'signup'").select("ts", "user_id", "val")
    out = _drained(spark, stream.stream_asof_join(views, updates, "user_id", "val"), "asof")
    return out.select(F.col("id").alias("event_id"), F.col("val").alias("zip"))
