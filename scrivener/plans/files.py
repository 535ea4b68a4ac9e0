"""Queries over generated files: what the readers make of them, held against the tables that they were made from."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions.columns import clamped_db, clock, finite, reference_text, seconds
from scrivener.functions.text import normalized, rounded
from scrivener.operators import chunks, lint, validate
from scrivener.plans import frames
from scrivener.plans.announcements import LETTERS, WIDE, han
from scrivener.plans.frames import SQL
from scrivener.plans.registry import query
from scrivener.sources import readers, store


def _joined(rows: DataFrame, by: str, line: Column, end: str = "\n") -> DataFrame:
    """path, raw: a file of the lines of each `by`, in the order of ord."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("_l")))), lambda x: x["_l"])
    return rows.groupBy(F.col(by).alias("path")).agg(F.array_join(lines, end).alias("raw"))


def _ms(x: str | Column) -> Column:
    return F.rint((F.col(x) if isinstance(x, str) else x) * 1000).cast("long")


def _stamp(ms: Column, mark: str = ",") -> Column:
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000), F.floor(ms % 60000 / 1000), ms % 1000)


def srt_files(c: DataFrame) -> DataFrame:
    """Byte order marks, CRLF, blank lines of white space, texts of two lines and blocks without times."""
    text = F.concat(F.regexp_replace("text", r"\s", "_"), F.lit("\r\nsecond"))
    block = F.concat((F.col("ord") + 1).cast("string"), F.lit("\r\n"), _stamp(F.col("start")), F.lit(" --> "), _stamp(F.col("end"), "."), F.lit("\r\n"), text, F.lit("\r\n \r\nno time\r\n"))
    return _joined(c, "set_id", block, "\r\n").withColumn("raw", F.concat(F.lit("﻿"), "raw"))


def json_files(c: DataFrame) -> DataFrame:
    cue = F.to_json(F.struct(F.when(F.col("ord") % 6 != 5, F.col("start") / 1000.0).alias("start"), (F.col("end") / 1000.0).alias("end"), F.when(F.col("ord") % 5 != 0, F.col("text")).alias("text"), F.col("role").alias("speaker")), {"ignoreNullFields": "false"})
    files = _joined(c, "set_id", cue, ",\n")
    whole = F.concat(F.lit("["), "raw", F.lit("]"))
    return files.withColumn("raw", F.when(F.col("path") % 2 == 0, F.concat(F.lit('{"segments":'), whole, F.lit("}"))).otherwise(whole))


def recap_files(c: DataFrame) -> DataFrame:
    at = F.floor(F.col("start") / 1000)
    stamp = F.when(F.col("set_id") % 2 == 0, clock(at)).otherwise(F.concat(F.floor(at / 60).cast("string"), F.lit(":"), (at % 60).cast("string")))
    cue = F.concat(F.lit("**"), "role", F.lit("**（"), stamp, F.lit("）\n"), F.regexp_replace("text", r"\s", "_"), F.lit("\nagain\n\nnot read\n"))
    return _joined(c, "set_id", cue).withColumn("raw", F.concat(F.lit("# title\n**x**（9:59）\nnot read\n## 逐字稿\n"), "raw"))


@query(f"WITH {SQL} SELECT set_id, ord, start, \"end\", length(text) + 7 AS chars FROM cues")
def q_srt_parse(spark, d):
    """Conversations written as SRT and read back."""
    c = readers.srt_cues(readers.clean(srt_files(frames.cues(spark, d))))
    row = F.row_number().over(frames.Window.partitionBy("path").orderBy("ord")) - 1
    return c.select(F.col("path").alias("set_id"), row.cast("long").alias("ord"), _ms("start").alias("start"), _ms("end").alias("end"), F.length("text").cast("long").alias("chars"))


@query(f"""WITH {SQL} SELECT set_id, ord, start, "end", CASE WHEN ord % 5 <> 0 THEN length(text) ELSE 0 END::BIGINT AS chars FROM cues WHERE ord % 6 <> 5""")
def q_json_cues(spark, d):
    """S3: lists and objects of cues; those without times are dropped, a null text is empty."""
    c = readers.json_cues(json_files(frames.cues(spark, d)))
    return c.select(F.col("path").alias("set_id"), F.col("ord").cast("long").alias("ord"), _ms("start").alias("start"), _ms("end").alias("end"), F.length("text").cast("long").alias("chars"))


RECAP_SQL = f"""WITH {SQL}, s AS (SELECT set_id, ord, role, text, start // 1000 AS s FROM cues),
e AS (SELECT *, CASE WHEN next IS NOT NULL THEN greatest(s, next) END AS e FROM (SELECT *, lead(s) OVER (PARTITION BY set_id ORDER BY ord) AS next FROM s)),
t AS (SELECT set_id, list_sort(list(e - s) FILTER (e > s)) AS took FROM e GROUP BY set_id),
r AS (SELECT set_id, ord, role, s, coalesce(e, s + coalesce(took[len(took) // 2 + 1], 5)) AS e, text FROM e JOIN t USING (set_id))"""


@query(f"{RECAP_SQL} SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY ord) - 1 AS ord, role AS speaker, s::DOUBLE AS start, e::DOUBLE AS \"end\", CASE WHEN text = '' THEN 0 ELSE length(text) + 6 END::BIGINT AS chars, true AS end_estimated FROM r")
def q_recap_cues(spark, d):
    """Speakers and starts alone; a cue ends where the next starts, the last after the upper median of the others."""
    c = readers.recap_cues(recap_files(frames.cues(spark, d)))
    row = F.row_number().over(frames.Window.partitionBy("path").orderBy("ord")) - 1
    return c.select(F.col("path").alias("set_id"), row.cast("long").alias("ord"), "speaker", "start", "end", F.length("text").cast("long").alias("chars"), "end_estimated")


@query(f"""{RECAP_SQL} SELECT set_id, count(*) AS cues, sum(CASE set_id % 4 WHEN 1 THEN s * 1000 ELSE start END)::BIGINT AS starts, set_id % 4 = 1 AS estimated FROM cues JOIN r USING (set_id, ord) WHERE set_id % 4 < 2 OR ord % 6 <> 5 GROUP BY ALL""")
def q_hyp_dispatch(spark, d):
    """Each file read by its suffix, any other as JSON."""
    c, suffix = frames.cues(spark, d), {0: ".SRT", 1: ".md", 2: ".json", 3: ".txt"}
    made = {0: srt_files, 1: recap_files, 2: json_files, 3: json_files}
    files = None
    for k, end in suffix.items():
        own = made[k](c.where(F.col("set_id") % 4 == k)).withColumn("path", F.concat(F.lit("/hyp/"), F.col("path").cast("string"), F.lit(end)))
        files = own if files is None else files.union(own)
    files = files.withColumn("path", F.regexp_replace("path", "SRT$", "srt"))
    read = readers.hyp_cues(readers.clean(files)).withColumn("set_id", F.regexp_extract("path", r"(\d+)\.", 1).cast("long"))
    return read.groupBy("set_id").agg(F.count("*").alias("cues"), F.sum(_ms("start")).alias("starts"), F.bool_or("end_estimated").alias("estimated"))


def golden_files(spark, d, broken: bool) -> tuple[DataFrame, DataFrame]:
    """(manifests, lines) as files (path, raw). broken: a fault a set, another for each remainder by 8."""
    c, fault = frames.cues(spark, d), F.col("set_id") % 8 if broken else F.lit(7)
    last = c.groupBy("set_id").agg(F.floor((F.max("end") + 700) / 60000).alias("last")).withColumn("fault", fault)
    first, at = lambda n: (F.col("fault") == n) & (F.col("k") == 0), F.col("k") * 60.0
    segment = F.to_json(F.struct(F.when(first(4), "long1").otherwise(F.concat(F.lit("S"), F.col("k").cast("string"))).alias("id"), at.alias("t_start"), F.when(first(5), at).otherwise(at + 60).alias("t_end"), F.when(~first(3), "minute").alias("reason")))
    segs = last.select("set_id", "fault", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("k")).select("set_id", F.col("k").alias("ord"), segment.alias("segment"))
    segs = _joined(segs, "set_id", F.col("segment"), ",").select(F.col("path").alias("set_id"), F.col("raw").alias("segments"))
    name = F.col("set_id").cast("string")
    head = F.concat(
        F.lit('{"set_id":"'), name, F.when(F.col("fault") == 6, "").otherwise('","source_audio":"a.wav'), F.lit('","source_md5":"'), F.when(F.col("fault") == 0, "x").otherwise(F.md5(name)), F.lit('","duration_sec":'),
        F.when(F.col("fault") == 1, F.lit(-1.0)).otherwise((F.col("last") + 1) * 60.0).cast("string"), F.when(F.col("fault") == 2, ',"speakers":[" "]').otherwise(""), F.lit(',"segments":['), "segments", F.lit("]}"),
    )
    place = lambda file: F.concat(F.lit("/golden/"), name, F.lit(f"/{file}")).alias("path")
    manifests = last.join(segs, "set_id").select(place("manifest.json"), head.alias("raw"))
    sec = F.floor(F.col("t_start") / 60000) + 1
    line = F.to_json(F.struct("id", "seg", (F.col("t_start") / 1000.0).alias("t_start"), (F.least(F.col("t_end"), sec * 60000) / 1000.0).alias("t_end"), "spk", "lang", F.concat(F.lit("="), "zh").alias("zh"), "models"))
    lines = _joined(frames.lines(spark, d).withColumn("ord", F.row_number().over(frames.Window.partitionBy("set_id").orderBy("ord"))), "set_id", line, "\n\n")
    return manifests, lines.withColumnRenamed("path", "set_id").select(place("lines.jsonl"), "raw")


GOLDEN_SQL = f"""WITH {SQL}, n AS (SELECT *, 2 * row_number() OVER (PARTITION BY set_id ORDER BY ord) - 1 AS n FROM lines),
last AS (SELECT set_id, (max("end") + 700) // 60000 AS last FROM cues GROUP BY set_id)"""


@query(f"""{GOLDEN_SQL} SELECT set_id, md5(set_id::VARCHAR) AS source_md5, last + 1 AS segments, (last + 1) * 60.0::DOUBLE AS duration_sec, count(n) AS lines, sum(n)::BIGINT AS numbers, sum(t_start)::BIGINT AS starts, sum(length(zh) + 1)::BIGINT AS chars
FROM last JOIN n USING (set_id) GROUP BY ALL""")
def q_golden_load(spark, d):
    """Manifests and lines, read, validated and typed."""
    m, s, rows = readers.golden(*golden_files(spark, d, False))
    rows = rows.groupBy("set_id").agg(F.count("*").alias("lines"), F.sum("ord").alias("numbers"), F.sum(_ms("t_start")).alias("starts"), F.sum(F.length("zh")).alias("chars"))
    segs = s.groupBy("set_id").agg(F.count("*").alias("segments"))
    return m.select("set_id", "source_md5", "duration_sec").join(segs, "set_id").join(rows, "set_id").withColumn("set_id", F.col("set_id").cast("long"))


@query(f"""{GOLDEN_SQL} SELECT set_id, 'manifest' AS place, CASE set_id % 8 WHEN 0 THEN 'source_md5 is no 32-digit hex' WHEN 1 THEN 'duration_sec is no positive finite number' WHEN 2 THEN 'speakers holds something else than names' ELSE 'missing source_audio' END AS error FROM last WHERE set_id % 8 IN (0, 1, 2, 6)
UNION ALL SELECT set_id, 'segment 0', CASE set_id % 8 WHEN 3 THEN 'missing reason' WHEN 4 THEN 'id is malformed' ELSE 't_end is not after t_start' END FROM last WHERE set_id % 8 IN (3, 4, 5)
UNION ALL SELECT set_id, 'line ' || n, CASE set_id % 8 WHEN 2 THEN 'unknown spk' WHEN 4 THEN 'unknown seg' ELSE 'outside its segment' END FROM n WHERE set_id % 8 = 2 OR set_id % 8 IN (4, 5) AND seg = 'S0'""")
def q_golden_errors(spark, d):
    """S1, validation of manifests, and of lines against them: every error of every set."""
    found = readers.golden_errors(*readers.golden_raw(*golden_files(spark, d, True)))
    return found.select(F.col("set_id").cast("long").alias("set_id"), "place", "error")


def _raw_lines(spark, d) -> DataFrame:
    """Lines as JSON, faults in some of them, by remainders of set_id + ord."""
    t = frames.lines(spark, d)
    every = lambda m, r: (F.col("set_id") + F.col("ord")) % m == r
    ident = F.when(every(9, 0), "L0").when(every(29, 3), " ").otherwise(F.col("id"))
    end = F.when(every(7, 1), F.col("t_start")).otherwise(F.col("t_end"))
    raw = F.to_json(F.struct(
        ident.alias("id"), "seg", "t_start", end.alias("t_end"), F.when(every(13, 4), "Z").otherwise("S1").alias("spk"), F.when(~every(5, 0), F.col("lang")).alias("lang"),
        F.when(~every(23, 7), F.col("zh")).alias("zh"), F.when(every(17, 5), F.col("zh")).alias("native"), F.when(~every(19, 6), F.col("models")).alias("models"),
    ), {"ignoreNullFields": "true"})
    raw = F.when(every(11, 3), F.regexp_replace(raw, r'"t_start":\d+', '"t_start":true')).when(every(19, 6), F.regexp_replace(raw, r"\}$", ',"models":"MX"}')).when(every(31, 8), F.substring(raw, 1, 9)).otherwise(raw)
    return t.select(F.col("set_id").cast("string").alias("set_id"), "ord", raw.alias("raw"))


RAW_SQL = f"""WITH {SQL}, y AS (SELECT *, set_id + ord AS u FROM lines),
x AS (SELECT set_id::VARCHAR AS set_id, ord, u, CASE WHEN u % 9 = 0 THEN 'L0' WHEN u % 29 = 3 THEN ' ' ELSE id END AS id, CASE WHEN u % 23 <> 7 THEN zh ELSE '' END AS zh, u % 11 = 3 AS untimed, NOT (u % 11 <> 3 AND u % 19 <> 6 AND u % 31 = 8) AS ok FROM y),
again AS (SELECT set_id, ord FROM (SELECT set_id, ord, id, row_number() OVER (PARTITION BY set_id, CASE WHEN ok THEN id END ORDER BY ord) AS n, ok FROM x) WHERE n > 1 AND ok AND trim(id) <> '')"""


@query(f"""{RAW_SQL} SELECT set_id, ord, 'missing lang' AS error FROM x WHERE ok AND u % 5 = 0 UNION ALL SELECT set_id, ord, 'unknown lang' FROM x WHERE ok AND u % 5 = 0
UNION ALL SELECT set_id, ord, 't_start or t_end is no number' FROM x WHERE ok AND untimed UNION ALL SELECT set_id, ord, 't_end is not after t_start' FROM x WHERE ok AND u % 7 = 1 AND NOT untimed
UNION ALL SELECT set_id, ord, 'missing zh' FROM x WHERE ok AND u % 23 = 7 UNION ALL SELECT set_id, ord, 'zh is empty' FROM x WHERE ok AND trim(zh) = ''
UNION ALL SELECT set_id, ord, 'unknown spk' FROM x WHERE ok AND u % 13 = 4 UNION ALL SELECT set_id, ord, 'id is no text' FROM x WHERE ok AND trim(id) = ''
UNION ALL SELECT set_id, ord, 'native equals zh' FROM x WHERE ok AND u % 17 = 5 AND trim(zh) <> '' UNION ALL SELECT set_id, ord, 'models is no list of texts' FROM x WHERE ok AND u % 19 = 6 AND NOT untimed
UNION ALL SELECT set_id, ord, 'malformed JSON or number' FROM x WHERE NOT ok UNION ALL SELECT set_id, ord, 'id is repeated' FROM again""")
def q_validate_errors(spark, d):
    """Validation of raw lines: every error of every line."""
    return validate.line_errors(_raw_lines(spark, d))


@query(f"{RAW_SQL} SELECT set_id, ord FROM again")
def q_duplicates(spark, d):
    """The second and later lines of an id."""
    return validate.line_errors(_raw_lines(spark, d)).where("error = 'id is repeated'").select("set_id", "ord")


@query(f"WITH {SQL} SELECT set_id::VARCHAR AS set_id, count(*) AS lines, sum(ord)::BIGINT AS ords FROM lines WHERE ord % 4 <> 0 GROUP BY set_id")
def q_store(spark, d):
    """Two versions saved, the latest read without its examples, and only so many versions kept."""
    root = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/annotations-{uuid.uuid4().hex}"
    row = lambda zh: F.to_json(F.struct("id", "seg", "t_start", "t_end", "spk", "lang", zh.alias("zh")))
    lines = frames.lines(spark, d).withColumn("set_id", F.col("set_id").cast("string"))
    store.save(lines.select("set_id", "ord", row(F.lit("x")).alias("raw")), root, keep=1)
    store.save(lines.select("set_id", "ord", row(F.when(F.col("ord") % 4 == 0, F.concat(F.lit(store.EXAMPLE), "zh", F.lit("）"))).otherwise(F.concat(F.lit("="), "zh"))).alias("raw")), root, keep=1)
    if len(store.versions(spark, root)) != 1:
        raise RuntimeError("more versions are kept than asked for")
    return store.read(spark, root).groupBy("set_id").agg(F.count("*").alias("lines"), F.sum("ord").alias("ords"))


@query("SELECT p_brand AS path, p_name AS term, count(*) AS n FROM part GROUP BY ALL")
def q_vocab(spark, d):
    """A list of terms a brand, with blank lines and white space."""
    p = frames.table(spark, d, "part").withColumn("ord", F.col("p_partkey"))
    return readers.vocab(_joined(p, "p_brand", F.concat(F.lit(" \t"), "p_name", F.lit("  \n ")))).groupBy("path", "term").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS bin_idx, event_id, (floor(coalesce(value, 0)) + 1)::BIGINT AS n FROM events),
l AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN -120.0::DOUBLE ELSE greatest(-120.0::DOUBLE, -n::DOUBLE) END AS rms_db FROM e)
SELECT rec, bin_idx, rms_db, CASE WHEN rec % 3 = 0 THEN rms_db ELSE greatest(-120.0::DOUBLE, -(n // 2 + 1)::DOUBLE) END AS peak_db FROM l""")
def q_level_bins(spark, d):
    """Logs of levels; where peaks do not pair up, the RMS stands for them."""
    e = frames.table(spark, d, "events").withColumn("_n", (F.floor(F.coalesce("value", F.lit(0.0))) + 1).cast("long"))
    order = frames.Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("ord", F.row_number().over(order))
    rms = F.when(F.col("event_id") % 11 == 0, "-inf").otherwise(F.concat(F.lit("-"), F.col("_n").cast("string")))
    peak = F.when((F.col("user_id") % 3 == 0) & (F.col("ord") == 1), "frame\n").otherwise(F.concat(F.lit("lavfi.astats.Overall.Peak_level=-"), (F.floor(F.col("_n") / 2) + 1).cast("string"), F.lit("\n")))
    logs = _joined(e, "user_id", F.concat(F.lit("lavfi.astats.Overall.RMS_level="), rms, F.lit("\n"), peak), "")
    return readers.level_bins(logs.withColumnRenamed("path", "rec"))


@query(f"WITH {SQL} SELECT set_id AS rec, 2 * start + 500 AS half_ms FROM cues WHERE ord % 3 = 2")
def q_silences(spark, d):
    """Middles of silences; ends that are not after their starts, and starts without an end, are dropped."""
    mark = lambda ms: F.format_string("%s%d.%03d", F.when(ms < 0, "-").otherwise(""), F.floor(F.abs(ms) / 1000), F.abs(ms) % 1000)
    end = F.col("start") + (F.col("ord") % 3 - 1) * 500
    logs = _joined(frames.cues(spark, d), "set_id", F.concat(F.lit("silence_start: "), mark(F.col("start")), F.lit("\n[x] silence_end: "), mark(end), F.lit(" | silence_duration: 1\n")), "")
    logs = logs.withColumn("raw", F.concat("raw", F.lit("silence_start: 99999.5\n"))).withColumnRenamed("path", "rec")
    return readers.silences(logs).select("rec", F.rint(F.col("at") * 2000).cast("long").alias("half_ms"))


@query("""SELECT p_partkey, printf('%d:%02d:%02d', p_partkey * 7 // 3600, p_partkey * 7 % 3600 // 60, p_partkey * 7 % 60) AS clock, (p_partkey * 7)::DOUBLE AS sec, (p_partkey * 7)::DOUBLE AS minutes FROM part""")
def q_clock(spark, d):
    """Seconds as h:mm:ss and back; minutes may exceed 59."""
    n = F.col("p_partkey") * 7
    t = frames.table(spark, d, "part").select("p_partkey", clock(n + 0.4).alias("clock"), F.concat(F.floor(n / 60).cast("string"), F.lit(":"), (n % 60).cast("string")).alias("m"))
    return t.select("p_partkey", "clock", seconds(F.col("clock")).alias("sec"), seconds(F.col("m")).alias("minutes"))


@query("SELECT event_id, format('{:.1f}', value)::DOUBLE AS tenth, format('{:.2f}', value / 8)::DOUBLE AS hundredth FROM events")
def q_rounded(spark, d):
    """binary doubles rounded to the nearest decimal."""
    return frames.table(spark, d, "events").select("event_id", rounded(F.col("value"), 1).alias("tenth"), rounded(F.col("value") / 8, 2).alias("hundredth"))


@query("""SELECT event_id, CASE WHEN event_id % 5 < 3 THEN -120.0::DOUBLE ELSE greatest(-120.0::DOUBLE, coalesce(-value * 2, -120)) END AS db, event_id % 5 >= 3 AND value IS NOT NULL AS sound FROM events""")
def q_clamped_db(spark, d):
    """what is no finite number, or below the floor, is the floor."""
    k, v = F.col("event_id") % 5, F.col("value") * -2
    token = F.when(k == 0, "-inf").when(k == 1, "nan").when(k == 2, "x").otherwise(v.cast("string"))
    value = F.when(k == 0, float("-inf")).when(k == 1, float("nan")).when(k > 2, v)
    return frames.table(spark, d, "events").select("event_id", clamped_db(token).alias("db"), finite(value).alias("sound"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_brand ELSE '' END AS native, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_name END AS zh FROM part")
def q_reference_text(spark, d):
    """The native text, or where there is none the other, or the empty one."""
    k = F.col("p_partkey") % 4
    t = frames.table(spark, d, "part").select("p_partkey", F.when(k == 1, "").when(k == 2, F.col("p_brand")).alias("native"), F.when(k != 3, F.col("p_name")).alias("zh"))
    return t.select("p_partkey", reference_text("native").alias("native"), reference_text("zh").alias("zh"))


@query("""SELECT p_partkey, upper(replace(p_brand, '#', '')) || p_size || '呃' || (p_size * 10000 + p_partkey % 9 * 1000 + 1000)::BIGINT || 'X' || list_reduce(list_transform(string_split(p_partkey::VARCHAR, ''), lambda c: c), lambda a, b: a || b) AS form,
  upper(replace(p_brand, '#', '')) || p_size || (p_size * 10000 + p_partkey % 9 * 1000 + 1000)::BIGINT || 'X' || p_partkey AS bare FROM part""")
def q_normal_forms(spark, d):
    """Full-width letters, numerals with and without units and myriads, fillers, punctuation and space of other scripts."""
    digits = lambda x: F.translate(x.cast("string"), "0123456789", "零一二三四五六七八九")
    n = F.concat(han(F.col("p_size")), F.lit("萬"), digits(F.col("p_partkey") % 9 + 1), F.lit("千"))
    text = F.concat(F.translate(F.upper("p_brand"), LETTERS, WIDE), F.lit("，"), han(F.col("p_size")), F.lit("。呃　"), n, F.lit("「x」"), digits(F.col("p_partkey")))
    t = frames.table(spark, d, "part").select("p_partkey", text.alias("t"))
    return t.select("p_partkey", normalized("t").alias("form"), normalized("t", True).alias("bare"))


@query(f"WITH {SQL} SELECT set_id, ord, start + 1000 * set_id AS start, \"end\" + 1000 * set_id AS \"end\" FROM cues")
def q_shifted(spark, d):
    """A chunk's cues in the recording's time."""
    return chunks.shifted(frames.cues(spark, d).withColumn("start_offset", F.col("set_id") * 1000)).select("set_id", "ord", "start", "end")


@query(f"""WITH RECURSIVE {SQL}, r AS (SELECT set_id AS rec, max("end") / 1000.0::DOUBLE AS total FROM cues GROUP BY set_id HAVING max("end") > 0),
pts AS (SELECT set_id AS rec, list(start / 1000.0::DOUBLE) AS pts FROM cues WHERE ord % 7 = 6 GROUP BY set_id),
c AS (
  SELECT rec, total, coalesce(pts, []) AS pts, 0 AS n, 0.0::DOUBLE AS a, 0.0::DOUBLE AS e FROM r LEFT JOIN pts USING (rec)
  UNION ALL
  SELECT rec, total, pts, n + 1, e, CASE WHEN total <= 60 OR target >= total OR cut <= e OR cut >= total OR total - cut < 10 THEN total ELSE cut END
  FROM (SELECT *, greatest(coalesce(list_sort(list_transform(list_filter(pts, lambda p: p >= greatest(e + 10, target - 15) AND p <= target + 5), lambda p: struct_pack(d := abs(p - target), p := p)))[1].p, target), least(e + 10, total)) AS cut
        FROM (SELECT *, e + 60 AS target FROM c WHERE e < total)))
SELECT rec, (n - 1)::INT AS "index", round(a, 3) AS start_offset, round(e, 3) - round(a, 3) AS duration FROM c WHERE n > 0""")
def q_plan_cuts(spark, d):
    """Cut plans of the conversations at their point cues."""
    c = frames.cues(spark, d)
    recs = c.groupBy(F.col("set_id").alias("rec")).agg((F.max("end") / 1000.0).alias("duration")).where("duration > 0")
    quiet = c.where("ord % 7 = 6").select(F.col("set_id").alias("rec"), (F.col("start") / 1000.0).alias("at"))
    return chunks.chunks(chunks.plan(recs, quiet, longest=60.0, back=15.0, forward=5.0, shortest=10.0))


def sources(spark, d) -> DataFrame:
    """path, content: a Python source a part, with none, one or two calls, or one that does not parse."""
    call = "CASE p_partkey % 5 WHEN 0 THEN 'sp.run([1], text=True)' WHEN 1 THEN 'sp.run([1], text=True, encoding=''utf-8'')' WHEN 2 THEN 'os.popen(1)' WHEN 3 THEN 'sp.getoutput(1); sp.Popen(1, universal_newlines=1, encoding=None)' ELSE 'def (' END"
    return frames.table(spark, d, "part").selectExpr("concat('p', p_partkey, '.py') as path", f"encode(concat('import os\\nimport subprocess as sp\\n', {call}, '\\n'), 'UTF-8') as content")


@query("""WITH v(k, fn, reason) AS (VALUES (0, 'run', 'text mode without an encoding'), (2, 'popen', 'always in the locale''s encoding'), (3, 'getoutput', 'always in the locale''s encoding'), (3, 'Popen', 'encoding=None states none'))
SELECT 'p' || p_partkey || '.py' AS path, 3::INT AS line, fn AS "function", reason, false AS unread FROM part JOIN v ON k = p_partkey % 5
UNION ALL SELECT 'p' || p_partkey || '.py', NULL, NULL, NULL, true FROM part WHERE p_partkey % 5 = 4""")
def q_lint(spark, d):
    """Generated sources scanned for calls without an encoding; one that does not parse is a row by itself."""
    return lint.lint(sources(spark, d)).select("path", "line", "function", "reason", F.col("error").isNotNull().alias("unread"))


@query("SELECT 'p' || p_partkey || '.py' AS path, CASE WHEN p_partkey % 5 = 3 THEN 2 ELSE 1 END::BIGINT AS violations FROM part WHERE p_partkey % 5 IN (0, 2, 3)")
def q_lint_counts(spark, d):
    """Violations a file; unread files are not counted."""
    return lint.lint_counts(lint.lint(sources(spark, d)))
