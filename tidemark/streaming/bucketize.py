"""The batch operators' streaming forms: right-closed buckets with a watermark, subscriptions, retention."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.selector import predicate


def bucketize(points: DataFrame, keys: list[str], span: int, aggregates: dict[str, Column], lateness: str = "0 seconds", time: str = "ts") -> DataFrame:
    """Buckets (end - span, end] of an event-time column; each is emitted once the watermark has passed its end.

    Spark's windows are closed on the left; moving time by one microsecond back and the end forward
    again closes them on the right. span is in microseconds.
    """
    moved = F.timestamp_micros(F.unix_micros(F.col(time).cast("timestamp")) - 1)
    rows = points.withColumn("_time", moved).withWatermark("_time", lateness)
    window = F.window("_time", f"{span} microseconds")
    out = rows.groupBy(*keys, window.alias("_w")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.unix_micros("_w.end").alias("tick"), *aggregates)


def sessions(points: DataFrame, keys: list[str], quiet: str, lateness: str, aggregates: dict[str, Column], time: str = "ts") -> DataFrame:
    """Pieces of activity with no gap of ``quiet`` or more."""
    rows = points.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", lateness)
    out = rows.groupBy(*keys, F.session_window("_time", quiet).alias("_w")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.unix_micros("_w.start").alias("start"), F.unix_micros("_w.end").alias("end"), *aggregates)


def subscribe(points: DataFrame, selectors: list[str], keys: tuple[str, ...], sample: float | None = None) -> DataFrame:
    """New points of the series that any of the selectors names."""
    cond = F.lit(False)
    for s in selectors:
        cond = cond | predicate(s, keys)
    out = points.where(cond)
    return out if sample is None else out.where(F.rand() < sample)


def in_bounds(points: DataFrame, tick: str, max_past: int, max_future: int) -> DataFrame:
    """Points within the accepted distance from now, in microseconds."""
    now = F.unix_micros(F.current_timestamp())
    return points.where((F.col(tick) >= now - max_past) & (F.col(tick) <= now + max_future))


def dedup(points: DataFrame, keys: list[str], lateness: str, time: str = "ts") -> DataFrame:
    """One point per series and time, the first to come, forgotten after the watermark."""
    return points.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", lateness).dropDuplicatesWithinWatermark([*keys, time]).drop("_time")


def stored(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All that an appending stream gives for what its source has now, as Parquet files that the executors write; no rows
    pass through the driver. The files lie below spark.checkpoint.dir or else the warehouse, and go when the driver ends."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        top = f"file://{os.path.join(tempfile.gettempdir(), 'tidemark-shared')}" if local else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{top.rstrip('/')}/tidemark-stream-{uuid.uuid4().hex[:12]}"
    atexit.register(_removed, spark, path)
    running = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _removed(spark: SparkSession, path: str) -> None:
    """At the end of the driver; a session that has been stopped can't remove anything."""
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
