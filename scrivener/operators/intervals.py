"""Interval joins by time buckets: each side goes to the buckets that it spans, a pair is kept in the later of both first buckets.

The join is an equi-join on recording and bucket, so it splits and skew-joins like any other, and is never broadcast; nothing is
compared across recordings or distant times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.functions.columns import joined, touches

BUCKET = 60.0


def _spread(df: DataFrame, start: str, end: str, name: str, bucket: float) -> DataFrame:
    first = F.floor(F.col(start) / bucket)
    last = F.greatest(first, F.floor(F.greatest(F.col(start), F.col(end)) / bucket))
    return df.withColumn(f"_{name}", first).withColumn("_b", F.explode(F.sequence(first, last)))


def touching(spans: DataFrame, cues: DataFrame, on: list[str], span: tuple[str, str] = ("t_start", "t_end"), cue: tuple[str, str] = ("start", "end"), bucket: float = BUCKET) -> DataFrame:
    """Pairs of a span and a cue that touch, with equal `on`. The sides share no other column names."""
    left = _spread(spans, *span, "sb", bucket)
    right = _spread(cues, *cue, "cb", bucket)
    both = joined(left, right, [*on, "_b"]).where(F.col("_b") == F.greatest("_sb", "_cb"))
    return both.where(touches(F.col(cue[0]), F.col(cue[1]), F.col(span[0]), F.col(span[1]))).drop("_b", "_sb", "_cb")


def touched(spans: DataFrame, cues: DataFrame, on: list[str], key: list[str], **kw) -> DataFrame:
    """Cues that touch some span, once each. key: columns that tell cues apart."""
    hit = touching(spans.select(*on, *kw.get("span", ("t_start", "t_end"))), cues, on, **kw).select(*key).distinct()
    return joined(cues, hit, key, "left_semi")


def untouched(spans: DataFrame, cues: DataFrame, on: list[str], key: list[str], **kw) -> DataFrame:
    """Cues that touch no span."""
    hit = touching(spans.select(*on, *kw.get("span", ("t_start", "t_end"))), cues, on, **kw).select(*key).distinct()
    return joined(cues, hit, key, "left_anti")
