"""Gateway traffic and periodic scans as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.operators.guard import inspect

TRAFFIC = "id long, ts timestamp, kind string, body string"


def traffic(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Requests and responses from JSON files that arrive in ``path``."""
    return spark.readStream.schema(TRAFFIC).option("maxFilesPerTrigger", max_files).json(path)


def gateway(stream: DataFrame, forward: Callable[[DataFrame], None], blocked: Callable[[DataFrame], None], audit: Callable[[DataFrame], None], checkpoint: str, block: bool = True, interval: str | None = None) -> StreamingQuery:
    """Inspects each batch once and hands it to three sinks: allowed rows, blocked rows, and the audit of all rows."""

    def each(batch: DataFrame, _id: int) -> None:
        x = inspect(batch, block).persist()
        try:
            forward(x.where("allow"))
            blocked(x.where("not allow"))
            audit(x)
        finally:
            x.unpersist()

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def risk_rate(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Requests and risky requests per event-time window, each id counted once while its window is open."""
    x = inspect(stream).withWatermark("ts", late).dropDuplicatesWithinWatermark(["id", "kind"]).where("kind = 'request'")
    return x.groupBy(F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.sum((F.size("risks") > 0).cast("int")).alias("risky")).select("w.start", "w.end", "requests", "risky")


def watch(spark: SparkSession, source: Callable[[], DataFrame], report: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 60) -> StreamingQuery:
    """Runs ``report(source(), tick)`` every so many seconds."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _b, i: report(source(), i)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
