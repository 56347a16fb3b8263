"""Streams of detections: windows, duplicates within a watermark, sessions, quiet fires, and the picture in micro-batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from cinderlake import dims
from cinderlake.shipping import ship
from cinderlake.storage import shared_dir

#: Late data up to the picture's window is taken in.
WATERMARK = "5 days"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``events`` as a stream of files, with event time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return raw.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", WATERMARK)


def deal(rows: DataFrame, path: str, files: int) -> None:
    """Adds ``rows`` to the folder as exactly ``files`` files, written and later read side by side: a file always has a row of its own, marked as none of ``rows``."""
    number = F.pmod(F.xxhash64(*rows.columns), F.lit(files)).cast("int").alias("file")
    marks = rows.sparkSession.range(files).select(*(F.lit(None).cast(c.dataType).alias(c.name) for c in rows.schema), F.lit(False).alias("real"), F.col("id").cast("int").alias("file"))
    rows.select("*", F.lit(True).alias("real"), number).unionByName(marks).repartitionById(files, "file").drop("file").write.mode("append").parquet(path)


def dealt(spark: SparkSession, schema: StructType, path: str, files: int) -> DataFrame:
    """The stream of what was dealt to the folder, each deal a batch of its own."""
    marked = StructType([*schema.fields, StructField("real", BooleanType())])
    return spark.readStream.schema(marked).option("maxFilesPerTrigger", files).parquet(path).where("real").drop("real")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote; sink and checkpoint lie in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/cinderlake-stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def daily(stream: DataFrame) -> DataFrame:
    """Events and their sum by UTC day and type."""
    return stream.groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"), F.expr("floor(sum(value) * 100 + 0.5)").alias("cents")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "cents")


def first_by_minute(stream: DataFrame) -> DataFrame:
    """One detection for each user, type and minute within the watermark."""
    keyed = stream.withColumn("minute", F.date_trunc("minute", "at"))
    return keyed.dropDuplicatesWithinWatermark(["user_id", "event_type", "minute"]).select("user_id", "event_type", F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"))


def sessions(stream: DataFrame, gap: str = "30 hours") -> DataFrame:
    """Bursts of a user's events with no gap of ``gap`` within."""
    return stream.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("begins"), "n")


STATUS = "user_id long, last_us long, n long, status string"


def track(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the last time and the number of events of a user; after the quiet hours a timeout marks the fire."""
    if state.hasTimedOut:
        last, n, step = state.get
        status = "out" if step else "contained"
        yield pd.DataFrame({"user_id": [key[0]], "last_us": [last], "n": [n], "status": [status]})
        if step:
            state.remove()
        else:
            state.update((last, n, 1))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, last // 1000 + int(dims.QUIET_OUT_H * 3_600_000)))
        return
    last, n, _ = state.get if state.exists else (0, 0, 0)
    for b in batches:
        n += len(b)
        last = max(last, int(b["us"].max()))
    state.update((last, n, 0))
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, last // 1000 + int(dims.QUIET_CONTAINED_H * 3_600_000)))
    yield pd.DataFrame({"user_id": [key[0]], "last_us": [last], "n": [n], "status": ["active"]})


def statuses(stream: DataFrame) -> DataFrame:
    """Per user the state of its fire as it changes: active, contained and out by event-time timeouts."""
    ship(stream.sparkSession)
    timed = stream.select("user_id", "at", F.unix_micros("at").alias("us"))
    return timed.groupBy("user_id").applyInPandasWithState(track, STATUS, "last_us long, n long, step int", "append", GroupStateTimeout.EventTimeTimeout)


def rebuild(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, every: str = "15 minutes", once: bool = False):
    """The picture, rebuilt after each micro-batch from all events so far: each batch joins them under its number, and one picture replaces the other."""

    def again(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/events/batch={number}")
        build(batch.sparkSession.read.parquet(f"{path}/events")).write.mode("overwrite").parquet(f"{path}/picture")

    trigger = {"availableNow": True} if once else {"processingTime": every}
    return stream.writeStream.foreachBatch(again).option("checkpointLocation", f"{path}/state").trigger(**trigger).start()
