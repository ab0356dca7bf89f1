"""Structured Streaming over the event stream: windows with late data, sessions, exponential state, stream-static and
stream-stream joins. Each has a batch twin with the same result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.sources.tables import upsert

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("top"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total", "top")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


EWMA_OUT = "user_id long, event_id long, ts timestamp, value double, ewma double"


def ewma(events: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Exponential mean per user, carried across micro-batches as state (events of a batch in order of ts). State grows with
    the users: one double each."""
    state = T.StructType([T.StructField("mean", T.DoubleType())])

    def run(key, pdfs: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        mean = held.get[0] if held.exists else None
        out = np.empty(len(x))
        for i, v in enumerate(x["value"].to_numpy(float)):
            mean = v if mean is None else (1 - alpha) * mean + alpha * v
            out[i] = mean
        held.update((float(mean),))
        yield pd.DataFrame({"user_id": key[0], "event_id": x["event_id"], "ts": x["ts"], "value": x["value"], "ewma": out})

    return events.groupBy("user_id").applyInPandasWithState(run, EWMA_OUT, state, "append", "NoTimeout")


def enriched(events: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Stream-static join."""
    return events.join(dimension, key, "left")


def matched(left: DataFrame, right: DataFrame, within: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """Stream-stream join on user within an interval: right at most ``within`` after left."""
    a = left.withWatermark("ts", late).alias("a")
    b = right.select(F.col("user_id").alias("u2"), F.col("ts").alias("ts2"), F.col("value").alias("value2")).withWatermark("ts2", late).alias("b")
    return a.join(b, F.expr(f"u2 = user_id AND ts2 >= ts AND ts2 <= ts + interval {within}"))


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what there is into a memory table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def versions(spark, path: str) -> list[tuple[int, str]]:
    """Whole versions of a table that ``upsert_table`` keeps, the newest last."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    whole = [n for n in names if n.startswith("v-") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted((int(n[2:]), f"{path}/{n}") for n in whole)


def current(spark, path: str):
    """The newest whole version, None before the first."""
    found = versions(spark, path)
    return spark.read.parquet(found[-1][1]) if found else None


def upsert_table(batch: DataFrame, path: str, keys: list[str]) -> None:
    """foreachBatch sink: replace the rows with the batch's keys (NULL keys are equal).

    Each batch writes the next version beside the last one; it counts from its ``_SUCCESS`` on, so a crash at any point
    leaves the table of the batch before. Older versions than the last two go.
    """
    spark = batch.sparkSession
    found = versions(spark, path)
    rows = upsert(spark.read.parquet(found[-1][1]), batch, keys) if found else batch
    rows.write.mode("overwrite").parquet(f"{path}/v-{(found[-1][0] if found else 0) + 1:09d}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for _, old in found[:-1]:
        p = jvm.org.apache.hadoop.fs.Path(old)
        p.getFileSystem(conf).delete(p, True)
