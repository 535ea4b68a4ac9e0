"""Cues, golden lines, windows and bins derived from the driver's tables, in whole milliseconds, and the same in SQL.

A conversation is a recording: a turn lasts 50 ms a character and every seventh is a point; a user's turn, 700 ms later, is a golden line.
Bins of a recording are the events of a user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET = 60_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    length = F.length(F.coalesce("text", F.lit(""))).cast("long") * 50
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.select(F.col("conv_id").alias("set_id"), F.lit("h").alias("hyp_id"), F.col("turn").alias("ord"), "role", F.coalesce("text", F.lit("")).alias("text"), length.alias("_len"))
    rows = rows.withColumn("start", F.coalesce(F.sum("_len").over(before.partitionBy("set_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    return rows.withColumn("end", F.col("start") + F.when(F.col("ord") % 7 == 6, 0).otherwise(F.col("_len"))).withColumn("end_estimated", F.lit(False)).drop("_len")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cues(spark, sf_dir).where("role = 'user'")
    a, b = F.col("start") + 700, F.greatest(F.col("end"), F.col("start") + 1000) + 700
    word = F.upper(F.substring_index("text", " ", 1))
    return rows.select("set_id", F.concat(F.lit("S"), F.floor(a / BUCKET).cast("string")).alias("seg"), F.concat(F.lit("L"), F.col("ord").cast("string")).alias("id"), "ord", a.alias("t_start"), b.alias("t_end"), F.lit("S1").alias("spk"), F.when(F.col("ord") % 4 == 0, "nan").otherwise("zho").alias("lang"), F.col("text").alias("zh"), F.lit(None).cast("string").alias("native"), F.array(word).alias("models"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = cues(spark, sf_dir).groupBy("set_id").agg(F.max("end").alias("last"))
    k = ends.select("set_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / BUCKET))).alias("k"))
    return k.select("set_id", F.concat(F.lit("S"), F.col("k").cast("string")).alias("seg"), (F.col("k") * BUCKET).alias("t_start"), ((F.col("k") + 1) * BUCKET).alias("t_end"), F.lit("minute").alias("reason"))


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    level = F.greatest(F.lit(-120.0), F.coalesce("value", F.lit(0.0)) / -4)
    return rows.select(F.col("user_id").alias("rec"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("bin_idx"), level.alias("rms_db"), (level + 3).alias("peak_db"))


SQL = """
cues AS (
  SELECT *, start + CASE WHEN ord % 7 = 6 THEN 0 ELSE len END AS "end" FROM (
    SELECT conv_id AS set_id, turn AS ord, role, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT * 50 AS len,
           coalesce(sum(length(coalesce(text, ''))::BIGINT * 50) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM conversations)),
lines AS (
  SELECT set_id, 'S' || ((start + 700) // 60000)::VARCHAR AS seg, 'L' || ord::VARCHAR AS id, ord, start + 700 AS t_start, greatest("end", start + 1000) + 700 AS t_end, text AS zh, CASE WHEN ord % 4 = 0 THEN 'nan' ELSE 'zho' END AS lang, upper(replace(split_part(text, ' ', 1), 'ß', 'ss')) AS model
  FROM cues WHERE role = 'user'),
segments AS (
  SELECT set_id, 'S' || k::VARCHAR AS seg, k * 60000 AS t_start, (k + 1) * 60000 AS t_end
  FROM (SELECT set_id, unnest(range(0, max("end") // 60000 + 1)) AS k FROM cues GROUP BY set_id)),
win AS (SELECT s.set_id, s.seg, s.t_start AS w0, s.t_end AS w1, c.ord, c.start, c."end", c.text FROM segments s JOIN cues c ON s.set_id = c.set_id
        AND CASE WHEN c."end" <= c.start THEN s.t_start <= c.start AND c.start <= s.t_end ELSE least(c."end", s.t_end) > greatest(c.start, s.t_start) END),
pairs AS (SELECT l.set_id, l.seg, l.id, l.t_start, l.t_end, l.lang, c.ord, c.start, c."end", c.text FROM lines l JOIN cues c ON l.set_id = c.set_id
          AND CASE WHEN c."end" <= c.start THEN l.t_start <= c.start AND c.start <= l.t_end ELSE least(c."end", l.t_end) > greatest(c.start, l.t_start) END)"""

BINS = """
bins AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS bin_idx, greatest(-120.0, coalesce(value, 0.0) / -4) AS rms_db, greatest(-120.0, coalesce(value, 0.0) / -4) + 3 AS peak_db FROM events),
floors AS (SELECT rec, quantile_cont(rms_db, 0.1) AS floor_db FROM bins GROUP BY rec),
wins AS (
  SELECT rec, bin_idx // 24 AS win_idx, count(*) AS bins, count(*) FILTER (rms_db > floor_db + 12) AS hot, 10 * log10(avg(pow(10.0, rms_db / 10))) AS rms, max(peak_db) AS peak, max(rms_db) - min(rms_db) AS dyn
  FROM bins JOIN floors USING (rec) GROUP BY ALL)"""


def normal_sql(text: str) -> str:
    """The normal form on text without numerals and compatibility characters, which the driver's tables lack."""
    return rf"regexp_replace(upper(replace({text}, 'ß', 'ss')), '[\p{{P}}\p{{Z}}\p{{C}}\s]', '', 'g')"
