"""Windows over event streams. Each function serves batch tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """events with ts as a timestamp (in UTC sessions the same reading), with a watermark if events may be late."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return t.withWatermark("ts", late) if late else t


def _counted(grouped) -> DataFrame:
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total)"""
    w = _counted(timed(events, late).groupBy(F.window("ts", width), "event_type"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str | None = None) -> DataFrame:
    w = _counted(timed(events, late).groupBy(F.window("ts", width, step), "event_type"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, end, n, total): events of a user less than the gap apart; the end is that of the last event plus the gap."""
    w = _counted(timed(events, late).groupBy(F.session_window("ts", gap), "user_id"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def running_queries(spark: SparkSession, folder: str, schema, checkpoint: str, name: str, make=tumbling, late: str = "1 hour", **options) -> DataFrame:
    """Read the files that are in a folder as a stream, through a window function into a table in memory, until all are read."""
    stream = spark.readStream.schema(schema).parquet(folder)
    query = make(stream, late=late, **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def streamed(spark: SparkSession, folder: str, schema, out: str, make=tumbling, **options) -> DataFrame:
    """All files that are in a folder as a stream through a window function, every window kept open to the end; the
    result of the last batch replaces that of the one before in out/result."""
    windowed = make(spark.readStream.schema(schema).parquet(folder), **options)
    write = lambda df, _: df.write.mode("overwrite").parquet(f"{out}/result")
    query = windowed.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/result")
