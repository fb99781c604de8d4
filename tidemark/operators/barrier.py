"""Aggregation between barriers. Every barrier gives a row, with zero where its window is empty."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clock import Markers, assign_marker, marker_line, settled, unused


def sync_aggregate(
    events: DataFrame,
    markers: DataFrame,
    partial: dict[str, Column],
    merge: dict[str, Column],
    keys: tuple[str, ...] = ("source",),
    finish: dict[str, Column] | None = None,
    empty: dict[str, object] | None = None,
    reset: bool = True,
    closed: str = "left",
) -> DataFrame:
    """A mergeable aggregate between markers: ``partial`` per (marker, keys), ``merge`` over the partials per marker.

    ``merge`` must not depend on order. Without ``reset`` the merged columns run on over all markers, which they may
    only do as sums. ``empty`` fills markers without events, ``finish`` derives columns at last.
    """
    markers = settled(markers)
    placed = _placed(events, markers, closed)
    return _aggregated(placed, markers, partial, merge, keys, finish, empty, reset)


_BUCKET = "_bucket_of_window"


def _placed(events: DataFrame, markers: Markers, closed: str) -> DataFrame:
    return assign_marker(events, markers, closed=closed, bucket=_BUCKET)


def _aggregated(
    placed: DataFrame,
    markers: Markers,
    partial: dict[str, Column],
    merge: dict[str, Column],
    keys: tuple[str, ...] = ("source",),
    finish: dict[str, Column] | None = None,
    empty: dict[str, object] | None = None,
    reset: bool = True,
) -> DataFrame:
    """``sync_aggregate`` of ``_placed`` events. The first window's events may lie in several buckets."""
    placed = placed.filter("marker is not null").withColumn(_BUCKET, F.when(F.col("previous").isNotNull(), F.col(_BUCKET)))
    parts = placed.groupBy(_BUCKET, "marker", *keys).agg(*[c.alias(n) for n, c in partial.items()])
    whole = parts.groupBy(_BUCKET, "marker").agg(*[c.alias(n) for n, c in merge.items()]).drop(_BUCKET)
    out = marker_line(markers).select("marker").join(whole, "marker", "left").fillna(empty or {n: 0 for n in merge})
    if not reset:
        so_far = Window.orderBy("marker").rowsBetween(Window.unboundedPreceding, 0)  # one row a marker
        out = out.select("marker", *[F.sum(n).over(so_far).alias(n) for n in merge])
    return out.withColumns(finish) if finish else out


def sync_fold(
    events: DataFrame,
    markers: DataFrame,
    update: Callable[[pd.DataFrame], dict],
    merge: Callable[[pd.DataFrame], dict],
    state: str,
    closed: str = "left",
) -> DataFrame:
    """(marker, state columns) of an aggregate that built-in functions cannot say; nulls where a window is empty.

    ``update`` folds some rows of a window into a state (a dictionary with the columns of ``state``), ``merge`` folds
    some states into one; both must not depend on order or grouping, and one state alone is left as it is. Rows are sorted
    by window first, in ranges that part large windows too: ``update`` runs once a window and batch, and a task sends one row
    a window."""

    def folded(rows: pd.DataFrame, fold: Callable[[pd.DataFrame], dict], least: int = 1) -> pd.DataFrame:
        """One state a marker; groups of less than ``least`` rows stay."""
        rows = rows.sort_values("marker", kind="stable", ignore_index=True)
        marks, rest = rows["marker"].to_numpy(), rows.drop(columns="marker")
        first = np.flatnonzero(np.append(True, marks[1:] != marks[:-1]))
        many = np.diff(first, append=len(marks)) >= least
        new = pd.DataFrame([{"marker": marks[a]} | fold(rest.iloc[a:b]) for a, b, m in zip(first, [*first[1:], len(marks)], many, strict=True) if m])
        kept = rows.iloc[first[~many]]
        whole = [part for part in (kept, new) if len(part)]
        return whole[0] if len(whole) == 1 else pd.concat(whole).sort_values("marker")

    def run(fold: Callable[[pd.DataFrame], dict], least: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last = None  # the state of the window that the next batch may go on with
            for batch in batches:
                if not len(batch):
                    continue
                found = folded(batch, fold, least)
                if last is not None and last["marker"].iloc[0] == found["marker"].iloc[0]:
                    last = folded(pd.concat([last, found.iloc[:1]]), merge)
                    found = found.iloc[1:]
                if len(found):
                    if last is not None:
                        yield last
                    yield found.iloc[:-1]
                    last = found.iloc[-1:]
            if last is not None:
                yield last

        return states

    kind, markers = f"marker long, {state}", settled(markers)
    placed = assign_marker(events, markers, closed=closed).filter("marker is not null").drop("previous")
    known = [c for c, t in placed.dtypes if "map<" not in t and "variant" not in t]  # what Spark can hash
    (part,) = unused(placed.columns, "_part")
    ranged = placed.withColumn(part, F.xxhash64(*known)).repartitionByRange("marker", part).sortWithinPartitions("marker").drop(part)
    near = ranged.mapInPandas(run(update, 1), kind)
    whole = near.repartition("marker").sortWithinPartitions("marker").mapInPandas(run(merge, 2), kind)
    return marker_line(markers).select("marker").join(whole, "marker", "left")


def barrier_window_sum(values: DataFrame, barriers: DataFrame, closed: str = "left") -> DataFrame:
    """(marker, total): the sum of val since the previous barrier."""
    return sync_aggregate(values, barriers, {"p": F.sum("val")}, {"total": F.sum("p")}, (), closed=closed)


def barrier_cumulative_sum(values: DataFrame, barriers: DataFrame, closed: str = "left") -> DataFrame:
    """(marker, total): the sum of every val before the barrier."""
    return sync_aggregate(values, barriers, {"p": F.sum("val")}, {"total": F.sum("p")}, (), reset=False, closed=closed)


def barrier_sum_by_source(values: DataFrame, barriers: DataFrame, closed: str = "left") -> DataFrame:
    """(marker, source, total) per source, and with a null source per barrier."""
    barriers = settled(barriers)
    placed = assign_marker(values, barriers, closed=closed).filter("marker is not null")
    parts = placed.groupBy("marker", "source").agg(F.sum("val").alias("total"))
    whole = marker_line(barriers).select("marker").join(parts.groupBy("marker").agg(F.sum("total").alias("total")), "marker", "left")
    whole = whole.select("marker", F.lit(None).cast(values.schema["source"].dataType).alias("source"), F.coalesce("total", F.lit(0)).alias("total"))
    return parts.unionByName(whole)


def heartbeat_then_barrier_sum(values: DataFrame, heartbeats: DataFrame, barriers: DataFrame, closed: str = "right") -> DataFrame:
    """(marker, total, n_intervals): sums per heartbeat interval, summed again per barrier of the heartbeats."""
    barriers = settled(barriers)
    beats = assign_marker(values, heartbeats, closed=closed).filter("marker is not null")
    beats = beats.groupBy(F.col("marker").alias("ts")).agg(F.sum("val").alias("val"))
    windows = assign_marker(beats, barriers, closed=closed).filter("marker is not null")
    sums = windows.groupBy("marker").agg(F.sum("val").alias("total"), F.count("*").alias("n_intervals"))
    return marker_line(barriers).select("marker").join(sums, "marker", "left").fillna(0)


def sum_by_timestamp(values: DataFrame, *by: str) -> DataFrame:
    return values.groupBy("ts", *by).agg(F.sum("val").alias("total"))


def count_by_timestamp(values: DataFrame, *by: str) -> DataFrame:
    return values.groupBy("ts", *by).agg(F.count("*").alias("n"))


def modulo_match(values: DataFrame, barriers: DataFrame, m: int = 100) -> DataFrame:
    """(kind, ts, val): values whose remainder is that of the last barrier time plus one (0 before the first), and a
    row per barrier with the sum of all values before it."""
    barriers = settled(barriers)
    placed = _placed(values, barriers, "left")
    target = F.coalesce(F.pmod(F.col("previous") + 1, F.lit(m)), F.lit(0))
    hits = placed.filter(F.pmod("val", F.lit(m)) == target).select(F.lit("value").alias("kind"), "ts", "val")
    sums = _aggregated(placed, barriers, {"p": F.sum("val")}, {"total": F.sum("p")}, (), reset=False)
    return hits.unionByName(sums.select(F.lit("sum").alias("kind"), F.col("marker").alias("ts"), F.col("total").alias("val")))


def _matching(trans: DataFrame, rules: Markers, closed: str, model: Column, same: Callable[[Column], Column]) -> DataFrame:
    """Placed rows of ``trans`` for which ``same`` holds of the model of the window that ended where the row's begins; it
    is 0 for an empty or no window. Models are small and come with the markers."""
    (found,) = unused([*trans.columns, "marker", "previous"], "_model")
    placed = _placed(trans, rules, closed).filter("marker is not null")
    bucket = F.when(F.col("previous").isNotNull(), F.col(_BUCKET))
    models = placed.groupBy(bucket, "marker").agg(model.alias(found)).select("marker", found)
    scored = assign_marker(trans, rules, closed=closed, carry=models)
    return scored.filter(same(F.coalesce(found, F.lit(0)))).drop(found)


def _flagged(trans: DataFrame, rules: Markers, m: int, closed: str) -> DataFrame:
    return _matching(trans, rules, closed, F.sum("val"), lambda x: F.pmod(x, F.lit(m)) == F.pmod("val", F.lit(m)))


def fraud_flags(trans: DataFrame, rules: DataFrame, m: int = 1000, closed: str = "left") -> DataFrame:
    """Transactions whose val equals the previous window's sum modulo ``m`` (sum 0 before the first rule). The open
    window after the last rule is scored too."""
    return _flagged(trans, settled(rules), m, closed).select(*trans.columns)


def fraud_stream(trans: DataFrame, rules: DataFrame, m: int = 1000, closed: str = "left") -> DataFrame:
    """(kind, ts, val): flagged transactions, and each rule with its window's sum."""
    rules = settled(rules)
    flags = _flagged(trans, rules, m, closed).select(F.lit("transaction").alias("kind"), "ts", "val")
    sums = barrier_window_sum(trans, rules, closed)
    return flags.unionByName(sums.select(F.lit("rule").alias("kind"), F.col("marker").alias("ts"), F.col("total").alias("val")))


def fraud_flags_count_model(trans: DataFrame, rules: DataFrame, m: int = 1000) -> DataFrame:
    """As ``fraud_flags``, but the model is the count of the previous window, val is not reduced, windows are
    ``(previous, rule]`` and the open window gives nothing."""
    scored = _matching(trans, settled(rules), "right", F.count("*"), lambda x: x % m == F.col("val"))
    return scored.filter("marker is not null").select(*trans.columns)


def rewindow_reduce(partials: DataFrame, size: int, value: str = "val") -> DataFrame:
    """(window_start, total) of tumbling windows of ``size`` over partial results of all keys."""
    start = (F.floor(F.col("ts") / F.lit(size)) * size).alias("window_start")
    return partials.groupBy(start).agg(F.sum(value).alias("total"))


def window_all(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One row over the whole input; none over an empty one."""
    return df.agg(F.count("*").alias("_n"), *aggregates).filter("_n > 0").drop("_n")


def window_all_per_partition(df: DataFrame, by: str, *aggregates: Column) -> DataFrame:
    return df.groupBy(by).agg(*aggregates)
