"""Rows that come behind the watermark: set aside where they can be read, instead of being dropped unseen.

A streaming aggregate silently drops rows whose window has been closed.  The router runs before it.  Each batch is
split by the watermark that Spark would use for it (the newest time of all earlier batches less the delay) into
``on_time/batch=N`` and ``late/batch=N``; the newest time so far is left in ``newest/batch=N``.  A batch only reads what
the batch before left and overwrites its own folders, so a batch that is replayed gives the same files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def window_end(ts: Column, width_s: int) -> Column:
    """End of the tumbling window of ``width_s`` seconds that holds ``ts``."""
    micros = width_s * 1_000_000
    return F.timestamp_micros((F.floor(F.unix_micros(ts) / micros) + 1) * micros)


def split_late(batch: DataFrame, watermark: Column, ts: str, width_s: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows in time, rows behind ``watermark``); with ``width_s``, a row is late when its window is closed.

    Before the first watermark (NULL) nothing is late; a row without a time is never late.
    """
    at = F.col(ts) if width_s is None else window_end(F.col(ts), width_s)
    late = F.coalesce(at < watermark if width_s is None else at <= watermark, F.lit(False))
    return batch.where(~late), batch.where(late)


def watermark_of(spark: SparkSession, out: str, number: int, delay_s: int):
    """The watermark that holds in batch ``number``, to the millisecond as Spark keeps it; None in the first."""
    if number == 0:
        return None
    newest = spark.read.schema("newest timestamp").parquet(f"{out}/newest/batch={number - 1}").first()[0]  # one row
    if newest is None:
        return None
    millis = F.unix_millis(F.lit(newest)) - 1000 * delay_s
    return F.timestamp_millis(millis)


def route_batch(batch: DataFrame, number: int, out: str, ts: str, delay_s: int, width_s: int | None = None) -> None:
    spark = batch.sparkSession
    mark = watermark_of(spark, out, number, delay_s)
    batch.persist()
    try:
        on_time, late = split_late(batch, F.lit(None).cast("timestamp") if mark is None else mark, ts, width_s)
        on_time.write.mode("overwrite").parquet(f"{out}/on_time/batch={number}")
        late.withColumn("watermark", F.lit(None).cast("timestamp") if mark is None else mark).write.mode("overwrite").parquet(f"{out}/late/batch={number}")
        before = spark.range(1).select(F.lit(None).cast("timestamp").alias("newest")) if number == 0 else spark.read.parquet(f"{out}/newest/batch={number - 1}")
        newest = batch.select(F.col(ts).alias("newest")).unionByName(before.select("newest")).agg(F.max("newest").alias("newest"))
        newest.write.mode("overwrite").parquet(f"{out}/newest/batch={number}")
    finally:
        batch.unpersist()


def route_late(stream: DataFrame, out: str, checkpoint: str, ts: str = "ts", delay_s: int = 600, width_s: int | None = None):
    """Run the router over a stream until its input is used up."""
    return (
        stream.writeStream.foreachBatch(lambda batch, number: route_batch(batch, number, out, ts, delay_s, width_s))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def on_time_rows(spark: SparkSession, out: str) -> DataFrame:
    """Routed rows that were in time, with their ``batch``; usable as ``spark.readStream`` source as well."""
    return spark.read.parquet(f"{out}/on_time")


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows that came too late, with their ``batch`` and the ``watermark`` that had passed them."""
    return spark.read.parquet(f"{out}/late")


def late_census(spark: SparkSession, out: str) -> DataFrame:
    """{batch, on_time, late, worst_s}: rows of each batch and how far the latest of them was behind."""
    behind = (F.unix_micros("watermark") - F.unix_micros("ts")) / 1e6
    late = late_rows(spark, out).groupBy("batch").agg(F.count("*").alias("late"), F.max(behind).alias("worst_s"))
    fine = on_time_rows(spark, out).groupBy("batch").agg(F.count("*").alias("on_time"))
    return fine.join(late, "batch", "full").select(
        F.col("batch").cast("long").alias("batch"), F.coalesce("on_time", F.lit(0)).alias("on_time"), F.coalesce("late", F.lit(0)).alias("late"), "worst_s"
    )
