"""Queries over the scores of the short sets: every column of the report, from the scorer that users call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.functions.text import error_rate_of, normalized, substring_costs_udf, substring_distance_udf
from scrivener.operators.score import Report, report_json, retention, score
from scrivener.plans.announcements import BY_SEGMENT, OVERALL, PER_LINE, sets, sql
from scrivener.plans.registry import query


def report(spark, d, drop_fillers: bool = False) -> Report:
    s = sets(spark, d)
    return score(s.segments, s.lines, s.cues, s.hyps, drop_fillers=drop_fillers, keep=DataFrame.persist)


@query(sql(OVERALL))
def q_overall(spark, d):
    """The scores of each hypothesis."""
    return report(spark, d).overall


@query(sql(BY_SEGMENT))
def q_by_segment(spark, d):
    """The scores of each segment."""
    return report(spark, d).by_segment


@query(sql(BY_SEGMENT, fillers="呃"))
def q_by_segment_without_fillers(spark, d):
    """the scores without fillers."""
    return report(spark, d, True).by_segment


@query(sql(PER_LINE))
def q_per_line(spark, d):
    """Edits charged to each line, by one alignment a segment."""
    return report(spark, d).per_line


@query(sql("SELECT set_id, hyp_id, seg, tp, fp, fn, model_precision, model_recall FROM (" + BY_SEGMENT + ")"))
def q_model_counts(spark, d):
    """The multiset difference of terms of lines and of cues, over the union of keys."""
    return report(spark, d).by_segment.select("set_id", "hyp_id", "seg", "tp", "fp", "fn", "model_precision", "model_recall")


@query(sql("SELECT set_id, hyp_id, seg, coverage FROM (" + BY_SEGMENT + ")"))
def q_coverage(spark, d):
    """The share of golden time whose lines are met with an error rate of at most a half."""
    return report(spark, d).by_segment.select("set_id", "hyp_id", "seg", "coverage")


@query(sql("SELECT set_id, hyp_id, seg, hallucination, hallucination_blocked_by FROM (" + BY_SEGMENT + ")"))
def q_hallucination(spark, d):
    """Unmatched time of each window, or why none is given."""
    return report(spark, d).by_segment.select("set_id", "hyp_id", "seg", "hallucination", "hallucination_blocked_by")


@query(sql("SELECT set_id, seg, hyp_id, cer_native, taigi_flatten_gap FROM (" + BY_SEGMENT + ")"))
def q_native(spark, d):
    """The error rate against the native track, and how far it is from that against the other."""
    return report(spark, d).by_segment.select("set_id", "seg", "hyp_id", "cer_native", "taigi_flatten_gap")


@query(sql("SELECT k AS set_id, seg, h AS hyp_id, CASE WHEN dialect_chars > 0 THEN hits * 10000.0::DOUBLE / dialect_chars END AS taigi_retention_per10k, hits AS taigi_hits, dialect_chars AS taigi_hyp_chars, dialect_sec AS sec FROM rows_ SEMI JOIN li USING (k, seg)"))
def q_retention(spark, d):
    """Dialect markers in the cues that touch dialect lines, each cue once."""
    s = sets(spark, d)
    return retention(s.lines, s.cues.withColumn("norm", normalized("text")), ["set_id", "seg"], s.hyps).withColumnRenamed("_taigi_sec", "sec")


@query(sql("SELECT k AS set_id, h AS hyp_id, CASE WHEN k % 23 <> 1 THEN (k % 50) / 120.0::DOUBLE END AS rtf FROM (SELECT DISTINCT k, h FROM segs)"))
def q_real_time_factor(spark, d):
    """NULL where the recording has no duration."""
    return report(spark, d).overall.select("set_id", "hyp_id", "rtf")


@query(sql("""SELECT k AS set_id, h AS hyp_id, false AS drop_fillers, len(vocab)::BIGINT AS vocab_size, sum(length(ref))::BIGINT AS ref_chars, count(*) AS segments, sum(lines)::BIGINT AS lines, string_agg(seg || coalesce(CASE WHEN judged THEN '' WHEN est THEN 'end_estimated' WHEN coarse THEN 'cue_too_coarse' ELSE 'no_hyp_in_window' END, ''), ',' ORDER BY seg) AS blocked
FROM rows_ JOIN vo USING (k) GROUP BY ALL"""))
def q_report_json(spark, d):
    """S11 and the report contract: the nested report as one JSON document a hypothesis, read back."""
    at = lambda path: F.get_json_object("report", f"$.{path}")
    rows = F.array_sort(F.from_json(at("by_segment"), "array<struct<seg string, hallucination_blocked_by string>>"))
    why = F.array_join(F.transform(rows, lambda x: F.concat(x["seg"], F.coalesce(x["hallucination_blocked_by"], F.lit("")))), ",")
    return report_json(report(spark, d)).select(
        "set_id", "hyp_id", (at("drop_fillers") == "true").alias("drop_fillers"), at("vocab_size").cast("long").alias("vocab_size"), at("overall.ref_chars").cast("long").alias("ref_chars"),
        F.json_array_length(at("by_segment")).cast("long").alias("segments"), F.json_array_length(at("per_line")).cast("long").alias("lines"), why.alias("blocked"),
    )


ALIGN = """WITH RECURSIVE q AS (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS ref, upper(replace(p_brand, '#', '') || p_type) AS hyp FROM part),
p AS (SELECT row_number() OVER () AS pid, ref, hyp FROM (SELECT DISTINCT ref, hyp FROM q)),
v AS (
  SELECT pid, 0 AS i, j::INT AS j, 0 AS v FROM p, LATERAL (SELECT unnest(range(0, length(hyp) + 1)) AS j)
  UNION ALL
  SELECT pid, i, j, min(c - j) OVER (PARTITION BY pid ORDER BY j) + j FROM (
    SELECT v.pid, i + 1 AS i, j, least(v + 1, coalesce(lag(v) OVER (PARTITION BY v.pid ORDER BY j) + (substr(ref, i + 1, 1) <> substr(hyp, j, 1))::INT, v + 1)) AS c
    FROM v JOIN p USING (pid) WHERE i < length(ref))),
d AS (SELECT p.pid, ref, hyp, min(v) AS dist, arg_min(j, v * 1000000 + j) AS j FROM v JOIN p USING (pid) WHERE i = length(ref) GROUP BY p.pid, ref, hyp)"""

TRACE = """, back AS (
  SELECT pid, length(ref) AS i, j, NULL::INT AS pos, 0 AS cost FROM d
  UNION ALL
  SELECT pid, CASE WHEN ins THEN i ELSE i - 1 END, CASE WHEN ins OR dia THEN j - 1 ELSE j END, i - 1, CASE WHEN ins THEN 1 WHEN dia THEN differs ELSE 1 END
  FROM (SELECT b.pid, b.i, b.j, coalesce(h.v = l.v + 1, false) AS ins, coalesce(h.v = g.v + (substr(ref, b.i, 1) <> substr(hyp, b.j, 1))::INT, false) AS dia, (substr(ref, b.i, 1) <> substr(hyp, b.j, 1))::INT AS differs
        FROM back b JOIN p ON p.pid = b.pid JOIN v h ON h.pid = b.pid AND h.i = b.i AND h.j = b.j
        LEFT JOIN v l ON l.pid = b.pid AND l.i = b.i AND l.j = b.j - 1 LEFT JOIN v g ON g.pid = b.pid AND g.i = b.i - 1 AND g.j = b.j - 1
        WHERE b.i > 0)),
each AS (SELECT pid, pos, sum(cost)::INT AS cost FROM back WHERE pos IS NOT NULL GROUP BY ALL)
SELECT p_partkey, pos::INT AS pos, cost FROM q JOIN p USING (ref, hyp) JOIN each USING (pid)"""


def _named(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet").repartition("p_partkey")  # a small file is read in few tasks
    return t.select("p_partkey", normalized("p_name").alias("ref"), normalized(F.concat("p_brand", "p_type")).alias("hyp"))


@query(ALIGN + " SELECT p_partkey, dist::INT AS distance, dist / length(ref) AS rate FROM q JOIN d USING (ref, hyp)")
def q_semiglobal(spark, d):
    """The fewest edits between each part's name and any substring of its brand and type."""
    rows = _named(spark, d).withColumn("distance", substring_distance_udf("ref", "hyp"))
    return rows.select("p_partkey", "distance", error_rate_of(F.col("ref"), F.col("hyp"), F.col("distance")).alias("rate"))


@query(ALIGN + TRACE)
def q_costs(spark, d):
    """the edits of one best alignment, charged to the characters of the name."""
    return _named(spark, d).select("p_partkey", F.posexplode(substring_costs_udf("ref", "hyp")).alias("pos", "cost"))
