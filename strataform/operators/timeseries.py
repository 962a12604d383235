"""Time series: points out of documents, rollups, ranges and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import align_down
from .documents import latest

MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
# Field names that hold a time or a value, in order of precedence, and those that never hold a value.
TIME_FIELDS = ("ts", "timestamp", "time", "timestamp_ms", "ts_ms", "time_ms")
NOT_VALUES = ("ts", "timestamp", "time", "timestamp_ms", "ts_ms", "time_ms", "date", "datetime", "series", "id", "key", "name", "tag", "device", "host")
VALUE_FIELDS = ("value", "v", "val", "reading", "metric", "measurement", "count", "data")


def number_field(json: Column, name: str) -> Column:
    """A field that is a JSON number, as double; text and booleans do not count."""
    v = F.try_variant_get(F.try_parse_json(json), f"$.{name}", "variant")
    numeric = F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(numeric, F.try_variant_get(F.try_parse_json(json), f"$.{name}", "double"))


def first_number(json: Column) -> Column:
    """The first field by name that is a JSON number and no time or label (``NOT_VALUES``), as double."""
    fields = F.map_entries(F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>"))
    numbers = F.filter(fields, lambda e: F.schema_of_variant(e["value"]).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & ~e["key"].isin(*NOT_VALUES))
    return F.array_min(F.transform(numbers, lambda e: F.struct(e["key"].alias("field"), e["value"].cast("double").alias("value"))))["value"]


def extract_points(docs: DataFrame, json: str = "doc", clock_ms: str = "updated_ms", parse_iso: bool = False) -> DataFrame:
    """(key, series, ts_ms, value) of documents; without a numeric time the document's clock is used.

    The series is a non-empty text field ``series``, else the key up to its first colon. The value is the
    first of ``VALUE_FIELDS`` that is a number, else the first number by field name. Documents without one are left out.
    """
    times = [number_field(F.col(json), f).cast("long") for f in TIME_FIELDS]
    if parse_iso:
        times += [F.unix_millis(F.try_to_timestamp(F.get_json_object(json, f"$.{f}"))) for f in TIME_FIELDS]
    named = F.try_variant_get(F.try_parse_json(F.col(json)), "$.series", "variant")
    series = F.when(F.schema_of_variant(named) == "STRING", F.nullif(F.get_json_object(json, "$.series"), F.lit("")))
    value = F.coalesce(*[number_field(F.col(json), f) for f in VALUE_FIELDS], first_number(F.col(json)))
    points = docs.select("key", F.coalesce(series, F.substring_index("key", ":", 1)).alias("series"), F.coalesce(*times, F.col(clock_ms)).alias("ts_ms"), value.alias("value"))
    return points.where("value is not null")


def newest_points(points: DataFrame, clock: str = "updated_ms") -> DataFrame:
    """One point per key, its newest write: a key written in two buckets counts in the later write's only."""
    return latest(points, ["key"], clock)


def rollup(points: DataFrame, bucket_ms: int = MINUTE_MS, order: str = "time") -> DataFrame:
    """Per series and bucket: count, min, max, sum, first and last (by time then key, or by key)."""
    by = F.struct("ts_ms", "key") if order == "time" else F.col("key")
    return points.groupBy("series", align_down(F.col("ts_ms"), bucket_ms).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.sum("value").alias("total"),
        F.min_by("value", by).alias("first"),
        F.max_by("value", by).alias("last"),
    )


def coarse_bucket(bucket_ms: int) -> int:
    """At least a minute, and whole minutes, rounded up."""
    return max(MINUTE_MS, -(-bucket_ms // MINUTE_MS) * MINUTE_MS)


def coarsen(fine: DataFrame, bucket_ms: int, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """Fold a minute rollup into coarse buckets; minutes that overlap [from, to] count whole."""
    if from_ms is not None:
        fine = fine.where(F.col("bucket") + MINUTE_MS > from_ms)
    if to_ms is not None:
        fine = fine.where(F.col("bucket") <= to_ms)
    step = coarse_bucket(bucket_ms)
    return fine.groupBy("series", align_down(F.col("bucket"), step).alias("coarse")).agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"), F.min_by("first", "bucket").alias("first"), F.max_by("last", "bucket").alias("last")
    ).withColumnRenamed("coarse", "bucket")


def in_range(points: DataFrame, from_ms: int, to_ms: int, series: str | None = None) -> DataFrame:
    found = points.where(F.col("ts_ms").between(from_ms, to_ms))
    return found.where(F.col("series") == series) if series else found


def retained(points: DataFrame, now_ms: int, days: int, by_chunk: bool = True) -> DataFrame:
    """Points that retention keeps: hourly chunks go whole once their newest point is too old, but for
    the newest chunk of all; or row by row."""
    cutoff = now_ms - days * DAY_MS
    if not by_chunk:
        return points.where(F.col("ts_ms") >= cutoff)
    chunk = align_down(F.col("ts_ms"), HOUR_MS)
    chunks = points.groupBy(chunk.alias("chunk")).agg(F.max("ts_ms").alias("newest"))
    newest = chunks.agg(F.max("chunk").alias("open"))
    keep = chunks.join(F.broadcast(newest), (F.col("newest") >= cutoff) | (F.col("chunk") == F.col("open")), "left_semi")  # one row is broadcast
    return points.withColumn("chunk", chunk).join(keep.select("chunk"), "chunk", "left_semi").drop("chunk")


def retention_report(points: DataFrame, now_ms: int, days: int) -> DataFrame:
    """(series, considered, dropped): chunks per series and how many a sweep drops."""
    cutoff = now_ms - days * DAY_MS
    chunks = points.groupBy("series", align_down(F.col("ts_ms"), HOUR_MS).alias("chunk")).agg(F.max("ts_ms").alias("newest"))
    return chunks.groupBy("series").agg(F.count(F.lit(1)).alias("considered"), F.count_if(F.col("newest") < cutoff).alias("dropped"))
