"""Level windows over a stream of bins: the batch operator's mean level and peak by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.functions.columns import mean_db


def windows(bins: DataFrame, width: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """rec, t_start, rms_db, peak_db, bins for a stream (rec, ts, rms_db, peak_db)."""
    seen = bins.withWatermark("ts", late).groupBy("rec", F.window("ts", width).alias("w"))
    return seen.agg(mean_db(F.col("rms_db")).alias("rms_db"), F.max("peak_db").alias("peak_db"), F.count("*").alias("bins")).select("rec", F.col("w.start").alias("t_start"), "rms_db", "peak_db", "bins")
