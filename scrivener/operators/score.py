"""Scores of hypotheses against golden lines, for all sets and hypotheses at once.

Frames: segments (set_id, seg, t_start, t_end, reason), lines (set_id, seg, id, ord, t_start, t_end, spk, lang, zh, native,
models), cues (set_id, hyp_id, ord, start, end, text, end_estimated). ord tells ties apart. What cannot be decided is NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions.columns import joined, ordered_text, overlap, ratio, reference_text
from scrivener.functions.text import error_rate_of, find_terms_udf, marker_hits, normalized, rounded, substring_costs_udf, substring_distance_udf
from scrivener.operators.intervals import touching, untouched

COVERED, COARSE = 0.5, 4.0
RUN, PART = ["set_id", "hyp_id"], ["set_id", "hyp_id", "seg"]


class Report(NamedTuple):
    overall: DataFrame
    by_segment: DataFrame
    per_line: DataFrame
    sets: DataFrame  #: set_id, drop_fillers, vocab_size


def met(lines: DataFrame, cues: DataFrame) -> DataFrame:
    """Pairs of a line and a cue that touch: set_id, seg, line_ord, lang, t_start, t_end, hyp_id, ord, start, end, norm and, where lines
    has it, _zh."""
    own = [c for c in ("_zh",) if c in lines.columns]
    return touching(lines.select("set_id", "seg", F.col("ord").alias("line_ord"), "lang", "t_start", "t_end", *own), cues.select(*RUN, "ord", "start", "end", "norm"), ["set_id"])


def retention(lines: DataFrame, cues: DataFrame, by: list[str], hyps: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Dialect markers per 10 000 characters of the cues that touch a dialect line, each cue once; by: grouping of the lines.

    cues need column norm. Rows exist for every group of lines and every hypothesis of its set: of hyps (set_id, hyp_id), or of cues.
    pairs: of met(), where it is there already."""
    hyps = cues.select(*RUN).distinct() if hyps is None else hyps.select(*RUN)
    total = lines.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("lang") == "nan", F.col("t_end") - F.col("t_start"))), F.lit(0.0)).alias("sec"))
    hit = (met(lines, cues) if pairs is None else pairs).where("lang = 'nan'").select(*by, "hyp_id", "ord", "start", "norm").distinct()
    text = hit.groupBy(*by, "hyp_id").agg(ordered_text(["start", "ord"], "norm").alias("text"))
    rows = joined(joined(total, hyps, ["set_id"]), text, [*by, "hyp_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("hits", marker_hits(F.col("text"))).withColumn("chars", F.length("text").cast("long"))
    return rows.select(*by, "hyp_id", ratio(F.col("hits") * 10000.0, F.col("chars")).alias("taigi_retention_per10k"), F.col("hits").alias("taigi_hits"), F.col("chars").alias("taigi_hyp_chars"), F.col("sec").alias("_taigi_sec"))


def hallucinated(segments: DataFrame, lines: DataFrame, cues: DataFrame) -> DataFrame:
    """Cues of a segment's window that touch none of the segment's lines."""
    inside = touching(segments.select("set_id", "seg", F.col("t_start").alias("w0"), F.col("t_end").alias("w1")), cues, ["set_id"], span=("w0", "w1"))
    return untouched(lines.select("set_id", "seg", "t_start", "t_end"), inside, ["set_id", "seg"], [*PART, "ord"])


def score(segments: DataFrame, lines: DataFrame, cues: DataFrame, hyps: DataFrame | None = None, vocab: DataFrame | None = None, drop_fillers: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Report:
    """hyps (set_id, hyp_id, asr_sec?, duration_sec?) names the hypotheses, those without cues included; by default those of cues.
    vocab (set_id, term): by default the terms of the set's lines. keep is applied to the normalised lines and cues, to the pairs of both
    that touch and to the table of segments, which are read several times: DataFrame.persist, say, or a function that writes and rereads
    them."""
    hyps = hyps if hyps is not None else cues.select(*RUN).distinct()
    timed = [c for c in ("asr_sec", "duration_sec") if c in hyps.columns]
    lines = joined(lines, segments.select("set_id", "seg"), ["set_id", "seg"], "left_semi")
    lines = lines.withColumn("_zh", normalized(reference_text("zh"), drop_fillers)).withColumn("_nat", normalized(reference_text("native"), drop_fillers))
    cues = cues.withColumn("norm", normalized("text", drop_fillers)).withColumn("end_estimated", F.coalesce("end_estimated", F.lit(False)))
    lines, cues = keep(lines), keep(cues)
    dur = F.col("t_end") - F.col("t_start")
    grid = joined(segments, hyps.select(*RUN), ["set_id"])

    refs = lines.groupBy("set_id", "seg").agg(
        ordered_text(["t_start", "ord"], "_zh").alias("ref_zh"), ordered_text(["t_start", "ord"], "_nat").alias("ref_nat"), F.count("*").alias("lines"),
        F.median(dur).alias("_med_line"), F.sum(dur).alias("gold_sec"), F.bool_or(F.trim(F.coalesce("native", F.lit(""))) != "").alias("has_native"),
    )
    window = touching(segments.select("set_id", "seg", F.col("t_start").alias("w0"), F.col("t_end").alias("w1")), cues.select(*RUN, "ord", "start", "end", "norm", "end_estimated"), ["set_id"], span=("w0", "w1"))
    pairs = keep(met(lines, cues))
    window = joined(window, pairs.select(*PART, "ord").distinct().withColumn("_met", F.lit(True)), [*PART, "ord"], "left")
    inside = overlap(F.col("start"), F.col("end"), F.col("w0"), F.col("w1"))
    heard = window.groupBy(*PART).agg(
        ordered_text(["start", "ord"], "norm").alias("hyp_txt"), F.count("*").alias("hyp_segments"), F.median(F.when(F.col("end") > F.col("start"), F.col("end") - F.col("start"))).alias("_med_cue"),
        F.bool_or("end_estimated").alias("_estimated"), F.sum(inside).alias("hyp_sec"), F.sum(F.when(F.col("_met").isNull(), inside)).alias("halluc_sec"),
    )
    near = pairs.groupBy(*PART, "line_ord").agg(ordered_text(["start", "ord"], "norm").alias("text"), F.first("_zh").alias("_zh"), F.first(dur).alias("dur"))
    covered = near.where(error_rate_of(F.col("_zh"), F.col("text")) <= COVERED).groupBy(*PART).agg(F.sum("dur").alias("cov_sec"))

    terms = lines.select("set_id", "seg", F.explode("models").alias("term")).withColumn("term", normalized("term"))
    wanted = (vocab.withColumn("term", normalized("term")) if vocab is not None else terms).groupBy("set_id").agg(F.collect_set("term").alias("vocab"))
    spoken = terms.groupBy("set_id", "seg", "term").agg(F.count("*").alias("r")).groupBy("set_id", "seg").agg(F.map_from_entries(F.collect_list(F.struct("term", "r"))).alias("_spoken"))
    zero = F.lit(0).cast("long")
    table = grid
    for part, key in ((refs, ["set_id", "seg"]), (spoken, ["set_id", "seg"]), (heard, PART), (covered, PART), (wanted, ["set_id"])):
        table = joined(table, part, key, "left")
    for c in ("ref_zh", "ref_nat", "hyp_txt"):
        table = table.withColumn(c, F.coalesce(c, F.lit("")))
    for c in ("lines", "hyp_segments"):
        table = table.withColumn(c, F.coalesce(c, zero))
    for c in ("hyp_sec", "halluc_sec", "cov_sec", "gold_sec"):
        table = table.withColumn(c, F.coalesce(c, F.lit(0.0)))
    table = table.withColumn("has_native", F.coalesce("has_native", F.lit(False))).withColumn("_estimated", F.coalesce("_estimated", F.lit(False)))
    table = table.withColumn("_costs", substring_costs_udf("ref_zh", "hyp_txt")).withColumn("dist_zh", F.aggregate("_costs", F.lit(0), lambda a, x: a + x))
    table = table.withColumn("_dist_nat", substring_distance_udf("ref_nat", "hyp_txt")).withColumn("_found", find_terms_udf("hyp_txt", "vocab"))

    table = table.withColumn("_spoken", F.coalesce("_spoken", F.expr("map()").cast("map<string,bigint>"))).withColumn("_found", F.coalesce("_found", F.expr("map()").cast("map<string,int>")))
    r, h = (lambda x: F.coalesce(F.try_element_at("_spoken", x), zero)), (lambda x: F.coalesce(F.try_element_at("_found", x).cast("long"), zero))
    either = F.array_union(F.map_keys("_spoken"), F.map_keys("_found"))
    for c, own in (("tp", lambda x: F.least(r(x), h(x))), ("fp", lambda x: F.greatest(zero, h(x) - r(x))), ("fn", lambda x: F.greatest(zero, r(x) - h(x)))):
        table = table.withColumn(c, F.aggregate(F.transform(either, own), zero, lambda a, x: a + x))
    dialect = retention(lines, cues, ["set_id", "seg"], hyps, pairs)
    table = joined(table, dialect, PART, "left")

    coarse = (F.coalesce("_med_line", F.lit(0.0)) != 0) & (F.coalesce("_med_cue", F.lit(0.0)) > F.col("_med_line") * COARSE)
    table = table.withColumn("_coarse", F.coalesce(coarse, F.lit(False))).withColumn("judgeable", (F.col("hyp_sec") > 0) & ~F.col("_coarse") & ~F.col("_estimated"))
    table = table.withColumn("ref_chars", F.length("ref_zh").cast("long")).withColumn("hyp_chars", F.length("hyp_txt").cast("long")).withColumn("_nat_chars", F.length("ref_nat").cast("long"))
    table = keep(table)
    cer = error_rate_of(F.col("ref_zh"), F.col("hyp_txt"), F.col("dist_zh"))
    cer_nat = error_rate_of(F.col("ref_nat"), F.col("hyp_txt"), F.col("_dist_nat"))
    dialect_columns = lambda t: [F.col("taigi_retention_per10k"), F.coalesce("taigi_hits", zero).alias("taigi_hits"), F.coalesce("taigi_hyp_chars", zero).alias("taigi_hyp_chars"), rounded(F.coalesce("_taigi_sec", F.lit(0.0)), 1).alias("taigi_sec")]
    by_segment = table.select(
        *PART, "reason", "lines", "hyp_segments", cer.alias("cer_content"), ratio(F.col("hyp_chars"), F.col("ref_chars")).alias("verbosity"), "ref_chars", "hyp_chars",
        F.when(F.col("has_native"), cer_nat).alias("cer_native"), F.when(F.col("has_native"), cer_nat - cer).alias("taigi_flatten_gap"), *dialect_columns(table),
        ratio(F.col("cov_sec"), F.col("gold_sec")).alias("coverage"), F.when(F.col("judgeable"), ratio(F.col("halluc_sec"), F.col("hyp_sec"))).alias("hallucination"),
        F.when(~F.col("judgeable"), F.when(F.col("_estimated"), "end_estimated").when(F.col("_coarse"), "cue_too_coarse").otherwise("no_hyp_in_window")).alias("hallucination_blocked_by"),
        rounded(F.coalesce("_med_cue", F.lit(0.0)), 1).alias("hyp_median_cue_sec"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("model_precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("model_recall"), "tp", "fp", "fn",
    )

    place = Window.partitionBy("set_id", "seg").orderBy("t_start", "ord")
    spans = lines.withColumn("_from", F.coalesce(F.sum(F.length("_zh")).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = spans.groupBy("set_id", "seg").agg(F.collect_list(F.struct("id", "lang", "spk", "_from", F.length("_zh").alias("ref_len"), dur.alias("sec"))).alias("_lines"))
    charged = lambda x: F.aggregate(F.slice("_costs", (x["_from"] + 1).cast("int"), x["ref_len"]), F.lit(0), lambda a, c: a + c)
    each = F.transform("_lines", lambda x: F.struct(x["id"], x["lang"], x["spk"], x["ref_len"], charged(x).alias("dist"), x["sec"]))
    per_line = joined(rows, table.select(*PART, "_costs"), ["set_id", "seg"]).select(*PART, F.explode(each).alias("x")).select(*PART, "x.id", "x.lang", "x.spk", "x.ref_len", "x.dist", rounded(F.col("x.sec"), 2).alias("sec"))

    judged = F.col("judgeable")
    total = table.groupBy(*RUN).agg(
        F.sum("ref_chars").alias("ref_chars"), F.sum("hyp_chars").alias("hyp_chars"), F.sum(F.when(F.col("ref_chars") > 0, F.col("dist_zh")).otherwise(0)).alias("dist"), F.sum((F.col("ref_chars") == 0).cast("long")).alias("ref_empty_segments"),
        F.sum("_nat_chars").alias("nat_chars"), F.sum(F.when(F.col("_nat_chars") > 0, F.col("_dist_nat")).otherwise(F.when(F.col("hyp_chars") > 0, 1).otherwise(0))).alias("dist_nat"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.sum("cov_sec").alias("cov"), F.sum("gold_sec").alias("golden_sec"), F.sum(F.when(judged, F.col("hyp_sec"))).alias("h"), F.sum(F.when(judged, F.col("halluc_sec"))).alias("x"), F.sum(judged.cast("long")).alias("hallucination_judged_segments"), F.count("*").alias("hallucination_total_segments"), F.bool_or("has_native").alias("nat"),
    )
    length_all = cues.groupBy(*RUN).agg(F.median(F.col("end") - F.col("start")).alias("_med"))
    total = joined(joined(joined(total, length_all, RUN, "left"), retention(lines, cues, ["set_id"], hyps, pairs), RUN, "left"), hyps.select(*RUN, *timed), RUN)
    cer_all, cer_nat_all = F.coalesce(ratio(F.col("dist"), F.col("ref_chars")), F.lit(0.0)), F.coalesce(ratio(F.col("dist_nat"), F.col("nat_chars")), F.lit(0.0))
    overall = total.select(
        *RUN, cer_all.alias("cer_content"), ratio(F.col("hyp_chars"), F.col("ref_chars")).alias("verbosity"), "ref_chars", "hyp_chars", "ref_empty_segments", F.when(F.col("nat"), cer_nat_all).alias("cer_native"), F.when(F.col("nat"), cer_nat_all - cer_all).alias("taigi_flatten_gap"),
        *dialect_columns(total), ratio(F.col("cov"), F.col("golden_sec")).alias("coverage"), F.when(F.col("hallucination_judged_segments") > 0, ratio(F.col("x"), F.col("h"))).alias("hallucination"), "hallucination_judged_segments", "hallucination_total_segments",
        rounded(F.coalesce("_med", F.lit(0.0)), 1).alias("hyp_median_cue_sec"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("model_precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("model_recall"), "golden_sec",
        *([ratio(F.col("asr_sec"), F.col("duration_sec")).alias("rtf")] if len(timed) == 2 else []),
    )
    sets = joined(hyps.select("set_id").distinct(), wanted, ["set_id"], "left").select("set_id", F.lit(drop_fillers).alias("drop_fillers"), F.when(F.col("vocab").isNull(), 0).otherwise(F.size("vocab")).cast("long").alias("vocab_size"))
    return Report(overall, by_segment, per_line, sets)


def report_json(report: Report) -> DataFrame:
    """The nested view: one JSON document per hypothesis."""
    nest = lambda df, name: df.groupBy(*RUN).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in RUN])).alias(name))
    overall = report.overall.select(*RUN, F.struct(*[c for c in report.overall.columns if c not in RUN]).alias("overall"))
    rows = joined(joined(overall, nest(report.by_segment, "by_segment"), RUN, "left"), nest(report.per_line, "per_line"), RUN, "left")
    rows = joined(rows, report.sets, ["set_id"])
    return rows.select(*RUN, F.to_json(F.struct("set_id", "drop_fillers", "vocab_size", "overall", "by_segment", "per_line"), {"ignoreNullFields": "false"}).alias("report"))
