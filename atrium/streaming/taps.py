"""Taps as a stream: the same session counts over a table or an unbounded source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = "30 minutes"


def session_counts(taps: DataFrame, gap: str = GAP, late: str | None = None) -> DataFrame:
    """(user_id, started, ended, taps) of taps (user_id, ts); a session ends after ``gap`` without a tap.

    On a stream give ``late``: how long out-of-order taps are waited for before a session is emitted.
    """
    kind = taps.schema["ts"].dataType  # event time must be an instant: a zoneless one is taken in the session's zone and given back
    rows = taps.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else taps
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("taps"))
    return out.select("user_id", F.col("w.start").cast(kind).alias("started"), F.col("w.end").cast(kind).alias("ended"), "taps")
