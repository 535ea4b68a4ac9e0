"""Cut plans: long recordings in chunks, cut at silences where one is near."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.functions.text import rounded

MAX_SEC, BACK_SEC, FORWARD_SEC, MIN_SEC = 1080.0, 45.0, 15.0, 60.0


def cut_points(total: float, silences: Iterable[float], longest: float = MAX_SEC, back: float = BACK_SEC, forward: float = FORWARD_SEC, shortest: float = MIN_SEC) -> list[float]:
    """Ends of the chunks, ascending; the last is total. Values that are not finite, a total or a longest chunk of 0 or less, and
    negative margins raise ValueError."""
    given = {"total": total, "longest": longest, "back": back, "forward": forward, "shortest": shortest}
    for name, value in given.items():
        if not math.isfinite(value) or value < 0 or (value == 0 and name in ("total", "longest")):
            raise ValueError(f"{name} can't be {value!r}")
    points, ends, at = sorted(p for p in silences if math.isfinite(p)), [], 0.0
    while total > longest and (target := at + longest) < total:
        near = points[bisect.bisect_left(points, max(at + shortest, target - back)) : bisect.bisect_right(points, target + forward)]
        end = max(min(near, key=lambda p: abs(p - target), default=target), min(at + shortest, total))
        if end <= at or end >= total or total - end < shortest:
            break
        ends.append(end)
        at = end
    return [*ends, float(total)]


def plan(recordings: DataFrame, silences: DataFrame, longest: float = MAX_SEC, back: float = BACK_SEC, forward: float = FORWARD_SEC, shortest: float = MIN_SEC) -> DataFrame:
    """rec, index, start, end for recordings (rec, duration) and silences (rec, at); one recording is one group."""

    def cuts(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ends = cut_points(float(frame["duration"].iloc[0]), frame["at"].dropna(), longest, back, forward, shortest)
        return pd.DataFrame({"rec": key[0], "index": range(len(ends)), "start": [0.0, *ends[:-1]], "end": ends})

    kind = dict(recordings.dtypes)["rec"]
    return recordings.join(silences, "rec", "left").groupBy("rec").applyInPandas(cuts, f"rec {kind}, index int, start double, end double")


def chunks(plan_: DataFrame) -> DataFrame:
    """rec, index, start_offset, duration: both ends rounded to the millisecond before they are subtracted, so chunks meet."""
    return plan_.select("rec", "index", rounded(F.col("start"), 3).alias("start_offset"), (rounded(F.col("end"), 3) - rounded(F.col("start"), 3)).alias("duration"))


def shifted(cues: DataFrame, offset: str = "start_offset") -> DataFrame:
    """A chunk's cues in the recording's time."""
    return cues.withColumn("start", F.col("start") + F.col(offset)).withColumn("end", F.col("end") + F.col(offset))
