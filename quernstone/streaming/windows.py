"""Windowed aggregates that run alike on a batch and on a stream, and runners for finite streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, ts: str, lateness: str | None = None) -> DataFrame:
    """The time column as TIMESTAMP (watermarks take no TIMESTAMP_NTZ), with a watermark if the frame streams."""
    out = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, lateness) if lateness is not None and df.isStreaming else out


def windowed(df: DataFrame, window: Column, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """window_start, window_end, keys and aggregates."""
    out = df.groupBy(window.alias("_w"), *keys).agg(*aggregates)
    rest = [c for c in out.columns if c not in ("_w", *keys)]
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *rest)


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], aggregates: list[Column], offset: str | None = None, lateness: str = "0 seconds") -> DataFrame:
    return windowed(event_time(df, ts, lateness), F.window(ts, size, size, offset), keys, aggregates)


def sliding(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], aggregates: list[Column], lateness: str = "0 seconds") -> DataFrame:
    return windowed(event_time(df, ts, lateness), F.window(ts, size, slide), keys, aggregates)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggregates: list[Column], lateness: str = "0 seconds") -> DataFrame:
    """Sessions that touch are one."""
    return windowed(event_time(df, ts, lateness), F.session_window(ts, gap), keys, aggregates)


def ohlc(df: DataFrame, ts: str, size: str, keys: list[str], price: str, volume: str, order: str, lateness: str = "2 seconds") -> DataFrame:
    """Open, high, low, close, volume, trades and volume-weighted price of each window."""
    from quernstone.operators.aggs import vwap

    aggs = [F.min_by(price, F.struct(ts, order)).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, F.struct(ts, order)).alias("close"), F.sum(volume).alias("volume"), F.count("*").alias("trades"), vwap(price, volume).alias("vwap")]
    return tumbling(df, ts, size, keys, aggs, lateness=lateness)


def stream_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, within: str, lateness: str = "10 minutes") -> DataFrame:
    """Left rows with right rows of the same key at most ``within`` earlier; state ends by the watermarks."""
    r = event_time(right, right_ts, lateness)
    r = r.select(*[F.col(c).alias(f"right_{c}") for c in r.columns])
    l = event_time(left, left_ts, lateness)
    cond = (F.col(by) == F.col(f"right_{by}")) & (F.col(f"right_{right_ts}") <= F.col(left_ts)) & (F.col(f"right_{right_ts}") >= F.col(left_ts) - F.expr(f"INTERVAL {within}"))
    return l.join(r, cond)


def distinct_within(df: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    """First row of each key: within the watermark on a stream, over all on a batch."""
    out = event_time(df, ts, lateness)
    return out.dropDuplicatesWithinWatermark(keys) if df.isStreaming else out.dropDuplicates(keys)


def parquet_stream(spark, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet files of a folder, or one file, as a stream."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        reader, path = reader.option("pathGlobFilter", p.getName()), str(p.getParent())
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def finished(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into Parquet under ``folder``, and read it."""
    out = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    else:
        # Complete and update results replace what was there: the last batch that had rows counts.
        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/data")

        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def split_late(batch: DataFrame, ts: str, watermark) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and late ones for a side output; for use in foreachBatch with a watermark held outside."""
    late = F.col(ts).cast("timestamp") < F.lit(watermark)
    return batch.filter(~late), batch.filter(late)
