"""Splits, indices and samples of recorded data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def split_by(df: DataFrame, path: str, *columns: str) -> None:
    """One folder per combination of ``columns``; readers prune by them."""
    df.write.partitionBy(*columns).parquet(path)


def with_row_index(df: DataFrame, *order: str, name: str = "row_index") -> DataFrame:
    """``df`` with its 0-based place in the order, without sorting in one task: rows are range-partitioned, numbered in
    their partition, and moved by the counts of the partitions before. ``order`` must settle all ties but those of equal
    rows. The numbered partitions are written once, since another run could choose other ranges."""
    # rows travel whole, so that no column of theirs can clash with the place
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    inner = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")
    kept = written(ranged.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"), F.spark_partition_id().alias("p"), inner), "row-index")
    counts = kept.groupBy("p").agg(F.count("*").alias("n"))  # a row a partition
    before = F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("p", F.coalesce(before, F.lit(0)).alias("o"))
    return kept.join(F.broadcast(offsets), "p").select("r.*", (F.col("i") + F.col("o")).alias(name))


def split_round_robin(df: DataFrame, n: int, *order: str) -> DataFrame:
    """``df`` with ``part``: row i goes to part i % n."""
    rows = with_row_index(df, *order, name="_row")
    return rows.select(*df.columns, F.pmod("_row", F.lit(n)).cast("int").alias("part"))


def split_contiguous(df: DataFrame, n: int, *order: str) -> DataFrame:
    """``df`` with ``part``: blocks of equal size, the last may be shorter."""
    rows = with_row_index(df, *order, name="_row")
    block = rows.agg(F.ceil(F.count("*") / F.lit(n)).alias("_block"))
    return rows.join(F.broadcast(block)).select(*df.columns, F.floor(F.col("_row") / F.col("_block")).cast("int").alias("part"))


def add_timestamps(df: DataFrame, *order: str, period: int = 1000) -> DataFrame:
    """``df`` with ts: the row's place times ``period``."""
    return with_row_index(df, *order, name="_row").select(*df.columns, (F.col("_row") * period).alias("ts"))


def cut_before(df: DataFrame, bound, column: str = "ts") -> DataFrame:
    return df.filter(F.col(column) < F.lit(bound))


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def column_domains(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """(column, value, n, first_row): distinct values of each column with counts and first place."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = df.select(F.col(row_id).alias("_r"), F.explode(pairs).alias("p"))
    return rows.groupBy("p.column", "p.value").agg(F.count("*").alias("n"), F.min("_r").alias("first_row"))
