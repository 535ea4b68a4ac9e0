"""Level and speech-density windows over bins (rec, bin_idx, rms_db, peak_db)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions.columns import joined, mean_db, ratio
from scrivener.functions.text import rounded

BIN_SEC, WINDOW_SEC, MARGIN_DB, FLOOR_PERCENTILE = 0.25, 60.0, 12.0, 10
QUIET_DENSITY, TOP, MIN_BINS = 0.30, 8, 12


def floors(bins: DataFrame, percentile: float = FLOOR_PERCENTILE) -> DataFrame:
    """rec, floor_db: the exact percentile of all bins of the recording."""
    return bins.groupBy("rec").agg(F.percentile("rms_db", percentile / 100).alias("floor_db"))


def windows(bins: DataFrame, floor: DataFrame | None = None, bin_sec: float = BIN_SEC, window_sec: float = WINDOW_SEC, margin_db: float = MARGIN_DB, present: bool = True) -> DataFrame:
    """rec, win_idx, t_start, t_end, rms_db, speech_rms_db, peak_db, speech_frac, dyn_range_db, bins, floor_db. present: rounded for reading."""
    per = max(1, int(round(window_sec / bin_sec)))
    rows = joined(bins, floor if floor is not None else floors(bins), ["rec"])
    speech = F.col("rms_db") > F.col("floor_db") + margin_db
    out = rows.groupBy("rec", F.floor(F.col("bin_idx") / per).alias("win_idx")).agg(
        mean_db(F.col("rms_db")).alias("rms_db"), F.count("*").alias("bins"), F.count(F.when(speech, 1)).alias("_n"), mean_db(F.when(speech, F.col("rms_db"))).alias("_s"),
        F.max("peak_db").alias("peak_db"), (F.max("rms_db") - F.min("rms_db")).alias("dyn_range_db"), F.first("floor_db").alias("floor_db"),
    )
    shown = (lambda x, n: rounded(x, n)) if present else (lambda x, n: x)
    start = F.col("win_idx") * per * bin_sec
    return out.select(
        "rec", "win_idx", shown(start, 2).alias("t_start"), shown(start + F.col("bins") * bin_sec, 2).alias("t_end"), shown(F.col("rms_db"), 2).alias("rms_db"), shown(F.when(F.col("_n") > 0, F.col("_s")), 2).alias("speech_rms_db"),
        shown(F.col("peak_db"), 2).alias("peak_db"), shown(ratio(F.col("_n"), F.col("bins")), 3).alias("speech_frac"), shown(F.col("dyn_range_db"), 2).alias("dyn_range_db"), "bins", "floor_db",
    )


def _top(rows: DataFrame, order: Column, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("rec").orderBy(order, "win_idx"))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def densest(rows: DataFrame, n: int = TOP) -> DataFrame:
    return _top(rows, F.desc("speech_frac"), n)


def quietest(rows: DataFrame, n: int = TOP, least: float = QUIET_DENSITY) -> DataFrame:
    return _top(rows.where(F.col("speech_frac") >= least), F.asc("rms_db"), n)


def speech_density(spans: DataFrame, bins: DataFrame, floor: DataFrame, key: list[str], bin_sec: float = BIN_SEC, margin_db: float = MARGIN_DB) -> DataFrame:
    """spans (rec, *key, start, end) with density and n_bins of the bins that they meet, at least one; NULL below MIN_BINS bins."""
    first = F.greatest(F.lit(0), F.floor(F.col("start") / bin_sec))
    last = F.greatest(first + 1, F.ceil(F.col("end") / bin_sec))
    wide = spans.select("rec", *key, F.explode(F.sequence(first, last - 1)).alias("bin_idx"))
    hot = F.count(F.when(F.col("rms_db") > F.col("floor_db") + margin_db, 1))
    met = joined(joined(wide, bins, ["rec", "bin_idx"]), floor, ["rec"]).groupBy("rec", *key).agg(hot.alias("_hot"), F.count("*").alias("n_bins"))
    out = joined(spans, met, ["rec", *key], "left").withColumn("n_bins", F.coalesce("n_bins", F.lit(0).cast("long")))
    return out.withColumn("density", F.when(F.col("n_bins") >= MIN_BINS, ratio(F.col("_hot"), F.col("n_bins")))).drop("_hot")
