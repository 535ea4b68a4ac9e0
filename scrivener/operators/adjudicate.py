"""Splits unmatched output by acoustic speech density, over merged runs of cues.

Cues of a segment merge while the pause is short and no golden line lies in it. Runs are islands of window functions: a new one starts
where the pause to the latest end so far is too long or blocked. Cues that end before they start count as ending at their start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions.columns import joined, verdict
from scrivener.functions.text import normalized, rounded
from scrivener.operators.intervals import BUCKET, _spread
from scrivener.operators.levels import speech_density
from scrivener.operators.score import hallucinated

GAP = 0.5


def merged(spans: DataFrame, occupied: DataFrame, part: list[str], seg: list[str], gap: float = GAP, bucket: float = BUCKET) -> DataFrame:
    """spans (part, seg, ord, start, end, text) as islands: part, seg, island, start, end, text, n_cues, cue_sec, span_sec.

    occupied (part, lo, hi): intervals that no merge may cross. part: the recording; seg: what divides spans further;
    bucket: of time, within which spans meet intervals."""
    rows = spans.withColumn("end", F.greatest("start", "end")).withColumn("text", F.coalesce("text", F.lit("")))
    order = Window.partitionBy(*part, *seg).orderBy("start", "ord")
    rows = rows.withColumn("_mx", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # Whatever blocks a run of cues lies in the pause before its next cue or, where there is none, over that cue's start.
    asked = rows.where(F.col("start") - F.col("_mx") <= gap).select(*part, *seg, "ord", "_mx", F.col("start").alias("_at"), F.least("_mx", "start").alias("_q"))
    asked, taken = _spread(asked, "_q", "_at", "qb", bucket), _spread(occupied.select(*part, "lo", "hi"), "lo", "hi", "ob", bucket)
    blocked = joined(asked, taken, [*part, "_b"]).where((F.col("hi") > F.col("_mx")) & (F.col("lo") < F.col("_at"))).select(*part, *seg, "ord").distinct().withColumn("_blocked", F.lit(True))
    rows = joined(rows, blocked, [*part, *seg, "ord"], "left")
    new = F.col("_mx").isNull() | (F.col("start") - F.col("_mx") > gap) | F.coalesce("_blocked", F.lit(False))
    rows = rows.withColumn("island", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "ord", "text"))), lambda x: x["text"]), "")
    out = rows.groupBy(*part, *seg, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), text.alias("text"), F.count("*").alias("n_cues"), F.sum(F.col("end") - F.col("start")).alias("cue_sec"))
    return out.withColumn("span_sec", F.greatest(F.lit(0.0), F.col("end") - F.col("start")))


def adjudicate(segments: DataFrame, lines: DataFrame, cues: DataFrame, bins: DataFrame, floor: DataFrame) -> DataFrame:
    """set_id, hyp_id, seg, start, end, cue_sec, span_sec, n_cues, text, density, n_bins, verdict. bins, floor: rec is the set_id."""
    lost = hallucinated(segments, lines, cues)
    occupied = lines.select("set_id", F.col("t_start").alias("lo"), F.col("t_end").alias("hi"))
    runs = merged(lost.select("set_id", "hyp_id", "seg", "ord", "start", "end", "text"), occupied, ["set_id"], ["hyp_id", "seg"])
    runs = speech_density(runs.withColumn("rec", F.col("set_id")), bins, floor, ["hyp_id", "seg", "island"])
    return runs.select("set_id", "hyp_id", "seg", "start", "end", rounded(F.col("cue_sec"), 2).alias("cue_sec"), rounded(F.col("span_sec"), 2).alias("span_sec"), "n_cues", normalized("text").alias("text"), "density", "n_bins", verdict(F.col("density")).alias("verdict"))


def verdict_totals(spans: DataFrame) -> DataFrame:
    """set_id, hyp_id, verdict, cue_sec, spans of adjudicate()'s rows."""
    return spans.groupBy("set_id", "hyp_id", "verdict").agg(F.sum("cue_sec").alias("cue_sec"), F.count("*").alias("spans"))
