"""Distinct counts over a stream: the bitmaps of probabilistic counting merge by bit_or."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.sketch import bucket_of, linear_hash, lowest_unset, stream_bit, tail_of
from loomgraph.operators.sketch import pcsa_buckets


def streaming_buckets(values: DataFrame, ks: list[int]) -> DataFrame:
    """(k, bucket, bm, r) of a streaming ``values`` (value); write it in complete or update mode.

    State is one bitmap a bucket, whatever the stream's length.
    """
    return pcsa_buckets(values, ks)


def windowed_buckets(values: DataFrame, k: int, time: str, width: str, delay: str) -> DataFrame:
    """(start, bucket, bm, r) of each window of event time; rows later than ``delay`` are left out.

    State is one bitmap a bucket for each window that the watermark still holds open, so the
    stream may run for ever; append mode writes a window once it has closed.
    """
    h, wide = linear_hash(F.col("value")), F.lit(k).cast("long")
    bits = values.where("value is not null").withWatermark(time, delay).select(time, bucket_of(h, wide).alias("bucket"), stream_bit(tail_of(h, wide)).alias("bit"))
    merged = bits.groupBy(F.window(time, width), "bucket").agg(F.bit_or("bit").alias("bm"))
    return merged.select(F.col("window.start").alias("start"), "bucket", "bm", lowest_unset(F.col("bm")).cast("long").alias("r"))
