"""Recorded streams in, result lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEASUREMENT = "id long, ts long, value string, property string, plug int, household int, house int"

# Columns of a connection record after its time, in order; and those that are categories.
CONNECTION = (
    "duration protocol service flag src_bytes dst_bytes land wrong_fragment urgent hot num_failed_logins logged_in "
    "num_compromised root_shell su_attempted num_root num_file_creations num_shells num_access_files num_outbound_cmds "
    "is_host_login is_guest_login count srv_count serror_rate srv_serror_rate rerror_rate srv_rerror_rate same_srv_rate "
    "diff_srv_rate srv_diff_host_rate dst_host_count dst_host_srv_count dst_host_same_srv_rate dst_host_diff_srv_rate "
    "dst_host_same_src_port_rate dst_host_srv_diff_host_rate dst_host_serror_rate dst_host_srv_serror_rate "
    "dst_host_rerror_rate dst_host_srv_rerror_rate"
).split()
CATEGORIES = ["protocol", "service", "flag", "land", "logged_in", "is_host_login", "is_guest_login"]


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """(id, ts in ms, val, kind, plug, household, house) of header-less CSV; kind is work (0) or load (1)."""
    raw = spark.read.schema(MEASUREMENT).csv(path)
    kind = F.when(F.trim("property") == "0", "work").when(F.trim("property") == "1", "load")
    return raw.select("id", (F.col("ts") * 1000).alias("ts"), F.col("value").cast("double").alias("val"), kind.alias("kind"), "plug", "household", "house")


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """(ts, cats, x, label) of header-less CSV of 43 fields; the label loses its full stop."""
    schema = ", ".join(["ts long", *(f"`{c}` {'string' if c in CATEGORIES else 'double'}" for c in CONNECTION), "label string"])
    raw = spark.read.schema(schema).csv(path)
    numbers = [F.col(f"`{c}`") for c in CONNECTION if c not in CATEGORIES]
    label = F.rtrim("label", F.lit("."))
    return raw.select("ts", F.array(*CATEGORIES).alias("cats"), F.array(*numbers).alias("x"), label.alias("label"))


def replay(spark: SparkSession, path: str, schema: str, ts: str = "ts", delay: str = "0 seconds", form: str = "parquet", glob: str | None = None):
    """A file folder as a stream with event time, one file a trigger."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.format(form).load(path)
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def result_lines(df: DataFrame, value: str = "value", ts: str = "ts", latency: str = "latency") -> DataFrame:
    """One line a result: time, value, logical time and latency."""
    time = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return df.select(F.format_string("%s %d @ %d [latency: %d ms]", time, value, ts, latency).alias("value"))


def write_result_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    result_lines(df).write.mode(mode).text(path)


def parse_result_lines(text: DataFrame, column: str = "value") -> DataFrame:
    """(config, latency_ms, throughput) of lines like ``450 vals/ms, ..., 17.48 ms, 328.08 events/ms``; nulls where a
    figure is missing."""
    number = lambda unit: F.expr(f"nullif(regexp_extract({column}, '([0-9.]+) {unit}', 1), '')").cast("double")
    config = F.trim(F.regexp_replace(column, r",?\s*[0-9.]+ (ms|events/ms)\b.*$", ""))
    return text.select(config.alias("config"), number("ms(?![a-z/])").alias("latency_ms"), number("events/ms").alias("throughput"))


def state_snapshots(result: DataFrame, marker: str = "marker") -> DataFrame:
    """The state after each synchronisation: one row a marker, its rows as an array of structs."""
    rest = [c for c in result.columns if c != marker]
    return result.groupBy(marker).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("state"))


def state_changes(result: DataFrame, *keys: str, marker: str = "marker") -> DataFrame:
    """``result``, the whole state after each synchronisation with a row a key, as its changes: the rows that differ
    from the key's row at the marker before, with ``gone`` false, and where a key is no longer there its last row once
    more, with ``gone`` true. No cell holds more than one key's values."""
    per, line = Window.partitionBy(*keys).orderBy(marker), Window.orderBy(marker)
    numbers = result.select(marker).distinct()  # one row a marker
    numbers = numbers.select(F.col(marker).alias("_m"), F.row_number().over(line).alias("_i"), F.lead(marker).over(line).alias("_next"))
    rows = result.join(numbers, F.col(marker) == F.col("_m")).drop("_m")
    rest = [c for c in result.columns if c not in (marker, *keys)]
    state = F.struct(*rest) if rest else F.lit(0)
    rows = rows.withColumns({"_s": state, "_before": F.lag("_i").over(per), "_old": F.lag(state).over(per), "_after": F.lead("_i").over(per)})
    new = F.col("_before").isNull() | (F.col("_before") < F.col("_i") - 1) | ~F.col("_old").eqNullSafe(F.col("_s"))
    changed = rows.filter(new).select(*result.columns, F.lit(False).alias("gone"))
    left = F.col("_next").isNotNull() & (F.col("_after").isNull() | (F.col("_after") > F.col("_i") + 1))
    ended = rows.filter(left).withColumn(marker, F.col("_next")).select(*result.columns, F.lit(True).alias("gone"))
    return changed.unionByName(ended)


def state_at(changes: DataFrame, at, *keys: str, marker: str = "marker") -> DataFrame:
    """The state after the last synchronisation at or before ``at``, one row a key."""
    rest = [c for c in changes.columns if c not in keys]
    known = changes.filter(F.col(marker) <= F.lit(at)).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(marker)).alias("_s"))
    return known.filter("not _s.gone").select(*keys, *[F.col(f"_s.`{c}`") for c in rest if c not in (marker, "gone")])


def states(changes: DataFrame, markers: DataFrame, *keys: str, marker: str = "marker") -> DataFrame:
    """The whole state after each of ``markers``, as ``state_changes`` was given it: every change lasts until the key's
    next one."""
    line, per = Window.orderBy(marker), Window.partitionBy(*keys).orderBy("_i")
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbers = markers.select(marker).distinct()  # one row a marker
    numbers = numbers.select(F.col(marker).alias("_m"), F.row_number().over(line).alias("_i"), F.count("*").over(every).cast("int").alias("_n"))
    rows = changes.join(numbers, F.col(marker) == F.col("_m")).drop("_m", marker)
    upto = F.coalesce(F.lead("_i").over(per) - 1, F.col("_n"))
    lasting = rows.withColumn("_upto", upto).filter("not gone").withColumn("_i", F.explode(F.sequence("_i", "_upto")))
    out = lasting.drop("_n", "_upto", "gone").join(numbers.drop("_n"), "_i").withColumnRenamed("_m", marker)
    return out.select(*[c for c in changes.columns if c != "gone"])
