"""What must not grow faster than the input: calls, rows of a task, sums beyond 2^53."""

import numpy as np
from pyspark import TaskContext
from pyspark.sql import functions as F

from tidemark.operators import barrier, load, outlier


def test_fold_calls(spark):
    """Rows of a window are folded together wherever they lie: a call a window, and a few where ranges part one."""
    rows = [((i * 7919) % 4000, 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "ts long, val long").repartition(16)
    marks = spark.range(1, 401).selectExpr("10 * id as ts")
    out = barrier.sync_fold(
        df, marks, lambda r: {"n": len(r), "calls": 1}, lambda s: {"n": s["n"].sum(), "calls": s["calls"].sum() + 1}, "n long, calls long"
    ).collect()
    assert [r.n for r in out] == [10] * 400
    assert sum(r.calls for r in out) <= 400 + 2 * 16


def test_fold_parts_large_windows(spark):
    """A window of one time is still folded by several tasks."""
    df = spark.range(200_000).selectExpr("5L as ts", "id as val")
    seen = lambda r: {"n": len(r), "tasks": 1 << TaskContext.get().partitionId()}
    both = lambda s: {"n": s["n"].sum(), "tasks": int(np.bitwise_or.reduce(s["tasks"].to_numpy()))}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        (row,) = barrier.sync_fold(df, spark.createDataFrame([(10,)], "ts long"), seen, both, "n long, tasks long").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert row.n == 200_000 and row.tasks.bit_count() > 1


def test_load_rows_of_a_task(spark, monkeypatch):
    """All keys begin with the first slice and have a row in every one; no task groups more than its part."""
    monkeypatch.setattr(load, "GROUP_ROWS", 100)
    rows = spark.range(60).selectExpr("id div 10 as house", "id div 2 as household", "id as plug", "1L as ts", "id as val")
    out = load.load_summaries(rows, spark.range(1, 41).selectExpr("10 * id as ts"), "s")
    parts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == (1 + 6 + 30 + 60) * 40 and max(parts) < 300


def test_moments_beyond_doubles(spark):
    """Sums over 2^53 are the doubles nearest to the true ones, in whatever order tasks add them up."""
    x = [90_000_001 + 2 * i for i in range(40)]
    df = spark.range(0, 40, 1, 40).selectExpr("array('a') as cats", "array(double(90000001 + 2 * id)) as x", "id")
    want = float(sum(v * v for v in x))
    assert np.cumsum([float(v * v) for v in x])[-1] != want  # what adding one after the other gives
    (row,) = outlier.itemset_moments(df, 1).collect()
    halves = [outlier.itemset_moments(df.filter(f"id % 2 = {k}"), 1) for k in (0, 1)]
    (both,) = outlier.merge_moments(*halves).collect()
    assert (row.n, row.l, row.s) == (40, [float(sum(x))], [want]) and both.n == 40 and abs(both.s[0] - want) <= 64


def test_row_groups_of_large_rows(spark):
    """Spark reads 4,096 rows of a row group at once: rows of half a megabyte must not fill one of 128 MB."""
    from pyarrow.parquet import ParquetFile

    from tidemark.sources.shared import Scratch

    rows = spark.range(0, 220, 1, 1).select("id", F.transform(F.sequence(F.lit(0), F.lit(65535)), lambda i: F.xxhash64(i, "id")).alias("x"))
    table = Scratch(spark, "t").table("rows", rows, large_rows=True)
    (path,) = table.inputFiles()
    found = ParquetFile(path.removeprefix("file://"))
    assert found.num_row_groups > 1 and max(found.metadata.row_group(i).num_rows for i in range(found.num_row_groups)) <= 101


def test_rows_of_a_scan_are_shuffled_once(spark, monkeypatch):
    """Blocks come from one table of packed rows; scores leave their block added up, for null and empty sources too."""
    monkeypatch.setattr(outlier, "CHUNK", 40)
    cats = "array(string(id % 2), string(id % 3)) as cats"
    df = spark.range(300).selectExpr("id as row", "element_at(array('a', '', null), int(id % 3) + 1) as source", cats, "array(double(id % 7), double(id % 11)) as x")
    got = outlier.row_scores(df, 2, by="source")
    assert got.columns == ["source", "row", "score"]
    slow = [outlier.anomaly_score(outlier.violation_scores(df.filter(F.col("source").eqNullSafe(s)), 2)) for s in ("a", "", None)]
    want = {r.row: r.score for part in slow for r in part.collect()}
    assert {r.row: r.score for r in got.collect()} == want and len(want) == 300
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "cats" not in plan and "Aggregate" not in plan
