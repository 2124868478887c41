"""Tumbling and sliding energy frames over a stream of (ts, recording_id, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_energy(stream: DataFrame, width: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Mean square per recording and window; rows later than ``late`` are left out on a stream.

    With ``slide`` the windows begin so far apart and overlap.  Null values
    don't count in the mean, rows without a time are in no window, and repeated
    rows count each.
    """
    marked = stream.withWatermark("ts", late) if stream.isStreaming else stream
    return marked.groupBy(F.window("ts", width, slide), "recording_id").agg(
        F.avg(F.col("value") * F.col("value")).alias("energy"), F.count(F.lit(1)).alias("n")
    ).select(F.col("window.start").alias("start"), "recording_id", "energy", "n")
