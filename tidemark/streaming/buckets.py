"""Row statistics of fixed buckets over a stream, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import finite


def stream_buckets(rows: DataFrame, time_column: str, value: str, length: str = "1 day", origin: str = "0 seconds", late: str = "1 hour") -> DataFrame:
    """bucket_start, bucket_end, n, total, lo, hi of finite values; held values need the following row, so they are left to
    the batch form."""
    stamped = rows.withColumn("__t", F.col(time_column).cast("timestamp")).withWatermark("__t", late)
    v = F.col(value).cast("double")
    held = stamped.where(finite(v)).groupBy(F.window("__t", length, length, origin)).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return held.select(F.unix_micros("window.start") / 1e6, F.unix_micros("window.end") / 1e6, "n", "total", "lo", "hi").toDF("bucket_start", "bucket_end", "n", "total", "lo", "hi")
