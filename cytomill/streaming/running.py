"""Running counts over unbounded inputs (an extension; batch results are the reference).

State is bounded: calls keep one row of sums per position, windows are dropped behind the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def running_calls(reads: DataFrame, position: tuple[str, ...] = ("chrom", "start", "motif")) -> DataFrame:
    """Calls of reads as they come, to be written in update mode; reads carry no overlap marks."""
    meth, seen = F.col("status") == C.METH, F.col("status").isin(C.METH, C.UNMETH)
    return reads.groupBy(*position).agg(F.sum(meth.cast("long")).alias("n_meth"), F.sum(seen.cast("long")).alias("n_total")).withColumn("beta_value", C.ratio(F.col("n_meth"), F.col("n_total")))


def windowed_counts(events: DataFrame, time: str, keys: tuple[str, ...], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling or sliding windows; rows later than ``late`` are dropped with their windows."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("begin"), F.col("window.end").alias("finish"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: tuple[str, ...], gap: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("finish"), *keys, "n")
