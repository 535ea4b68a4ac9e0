"""Readers: golden sets, hypotheses (JSON, SRT, recap Markdown), vocabularies, level and silence logs, source trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivener.functions.columns import clamped_db, seconds
from scrivener.operators.validate import line_errors, manifest_errors

LINE_SCHEMA = "id string, seg string, t_start double, t_end double, spk string, lang string, zh string, native string, models array<string>, topic string, note string"
SEGMENT_SCHEMA = "id string, t_start double, t_end double, reason string, clip string, post_edit boolean"
MANIFEST_SCHEMA = f"set_id string, source_audio string, source_md5 string, duration_sec double, speakers array<string>, segments array<struct<{SEGMENT_SCHEMA}>>"
HEADING = "## 逐字稿"
RECAP_CUE = r"^\*\*([^*\n]{1,20})\*\*\s*[（(]\s*([\d:]+)\s*[）)]\s*$"
SRT_TIME = r"(\d+):(\d{2}):(\d{2})[,.](\d{1,3})\s*-->\s*(\d+):(\d{2}):(\d{2})[,.](\d{1,3})"
RMS = r"lavfi\.astats\.Overall\.RMS_level=(-?inf|-?\d+(?:\.\d+)?)"
PEAK = r"lavfi\.astats\.Overall\.Peak_level=(-?inf|-?\d+(?:\.\d+)?)"
TAIL_SEC = 5.0


class GoldenError(ValueError):
    """A golden set that breaks its schema; the message lists every error."""


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, raw: each file as one text, without a byte order mark, lines ended by LF."""
    return clean(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")))


def clean(files: DataFrame) -> DataFrame:
    """files (path, raw) without a byte order mark, lines ended by LF."""
    return files.withColumn("raw", F.replace(F.regexp_replace("raw", "^﻿", ""), F.lit("\r\n"), F.lit("\n")))


def _numbered_lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("raw", "\n")).alias("ord", "line"))


def golden_raw(manifest_files: DataFrame, line_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifests: set_id, raw; lines: set_id, ord, raw) of files (path, raw) that lie in one directory a set. set_id is the
    manifest's, or else the directory."""
    where = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    manifests = manifest_files.select(where.alias("dir"), "raw")
    manifests = manifests.withColumn("set_id", F.coalesce(F.get_json_object("raw", "$.set_id"), "dir"))
    lines = _numbered_lines(line_files).select(where.alias("dir"), (F.col("ord") + 1).alias("ord"), F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")).alias("raw")).where("raw <> ''")
    return manifests.select("set_id", "raw"), lines.join(manifests.select("dir", "set_id"), "dir").select("set_id", "ord", "raw")


def golden_errors(manifests: DataFrame, lines: DataFrame) -> DataFrame:
    """set_id, place, error: every error of every set of golden_raw()."""
    top = manifest_errors(manifests).select("set_id", F.coalesce(F.concat(F.lit("segment "), F.col("place")), F.lit("manifest")).alias("place"), "error")
    return top.union(line_errors(lines, manifests).select("set_id", F.concat(F.lit("line "), F.col("ord")), "error"))


def golden(manifest_files: DataFrame, line_files: DataFrame, shown: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifests, segments, lines), or GoldenError with the errors of every set. shown: list so many at most, and their number."""
    manifests, lines = golden_raw(manifest_files, line_files)
    bad = golden_errors(manifests, lines).orderBy("set_id", "place", "error")
    if found := (bad if shown is None else bad.limit(shown)).collect():
        more = [f"the first {shown} of {n} errors; all are in golden_errors()"] if len(found) == shown and (n := bad.count()) > shown else []
        raise GoldenError("\n".join([f"{x.set_id}, {x.place}: {x.error}" for x in found] + more))
    m = manifests.select(F.from_json("raw", MANIFEST_SCHEMA).alias("m")).select("m.*")
    segments = m.select("set_id", F.explode("segments").alias("s")).select("set_id", F.col("s.id").alias("seg"), "s.t_start", "s.t_end", "s.reason", "s.clip", "s.post_edit")
    return m.drop("segments"), segments, lines.select("set_id", "ord", F.from_json("raw", LINE_SCHEMA).alias("l")).select("set_id", "ord", "l.*")


def load_golden(spark: SparkSession, path: str, shown: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """golden() of the directories that path (a glob, too) names."""
    return golden(whole_files(spark, f"{path}/manifest.json"), whole_files(spark, f"{path}/lines.jsonl"), shown)


def json_cues(files: DataFrame) -> DataFrame:
    """path, ord, start, end, text: a list of cues, or an object with one under `segments`; cues without times are dropped."""
    item = "array<struct<start double, end double, text string>>"
    rows = F.coalesce(F.from_json(F.get_json_object("raw", "$.segments"), item), F.from_json("raw", item))
    return files.select("path", F.posexplode(rows).alias("ord", "c")).where("c.start is not null and c.end is not null").select("path", "ord", "c.start", "c.end", F.coalesce("c.text", F.lit("")).alias("text"), F.lit(False).alias("end_estimated"))


def srt_cues(files: DataFrame) -> DataFrame:
    """path, ord, start, end, text. A fraction counts milliseconds as it is written: `.5` is 5. Blocks without times are dropped."""
    block = files.select("path", F.posexplode(F.split("raw", r"\n(?:[^\S\n]*\n)+|^(?:[^\S\n]*\n)+")).alias("ord", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(SRT_TIME)), True)
    block = block.select("path", "ord", lines.alias("lines"), at.cast("int").alias("at")).where("at > 0")
    part = lambda i: F.regexp_extract(F.element_at("lines", F.col("at")), SRT_TIME, i).cast("long")
    stamp = lambda i: part(i) * 3600 + part(i + 1) * 60 + part(i + 2) + part(i + 3) / 1000.0
    rest = F.array_join(F.slice("lines", F.col("at") + 1, F.size("lines")), " ")
    return block.select("path", "ord", stamp(1).alias("start"), stamp(5).alias("end"), rest.alias("text"), F.lit(False).alias("end_estimated"))


def recap_cues(files: DataFrame) -> DataFrame:
    """path, ord, start, end, text, speaker, end_estimated (always true). A cue ends where the next starts; the last lasts the upper median
    of the others' positive durations, or 5 s. Only what follows the transcript's heading is read, if it is there."""
    body = F.when(F.instr("raw", HEADING) > 0, F.substring(F.col("raw"), F.instr("raw", HEADING), F.length("raw"))).otherwise(F.col("raw"))
    line = files.select("path", F.posexplode(F.split(body, "\n")).alias("n", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    head = F.col("line").rlike(RECAP_CUE)
    order = Window.partitionBy("path").orderBy("n")
    line = line.withColumn("cue", F.max(F.when(head, F.col("n"))).over(order)).where("cue is not null").withColumn("_head", head)
    stop = ~F.col("_head") & ((F.col("line") == "") | F.col("line").startswith("## "))
    line = line.withColumn("_stopped", F.max(stop.cast("int")).over(Window.partitionBy("path", "cue").orderBy("n")))
    words = F.transform(F.array_sort(F.collect_list(F.when(~F.col("_head") & (F.col("_stopped") == 0), F.struct("n", "line")))), lambda x: x["line"])
    cue = line.groupBy("path", "cue").agg(F.max(F.when(F.col("_head"), F.col("line"))).alias("h"), F.array_join(words, " ").alias("text"))
    cue = cue.select("path", F.col("cue").alias("ord"), F.trim(F.regexp_extract("h", RECAP_CUE, 1)).alias("speaker"), seconds(F.regexp_extract("h", RECAP_CUE, 2)).alias("start"), "text")
    cue = cue.withColumn("end", F.greatest("start", F.lead("start").over(Window.partitionBy("path").orderBy("ord"))))
    lasts = F.lead("ord").over(Window.partitionBy("path").orderBy("ord")).isNull()
    cue = cue.withColumn("_last", lasts)
    took = F.array_sort(F.collect_list(F.when(~F.col("_last") & (F.col("end") > F.col("start")), F.col("end") - F.col("start"))))
    tail = cue.groupBy("path").agg(took.alias("t")).select("path", F.when(F.size("t") > 0, F.element_at("t", (F.floor(F.size("t") / 2) + 1).cast("int"))).otherwise(TAIL_SEC).alias("tail"))
    out = cue.join(tail, "path").withColumn("end", F.when(F.col("_last"), F.col("start") + F.col("tail")).otherwise(F.col("end")))
    return out.select("path", "ord", "start", "end", "text", "speaker", F.lit(True).alias("end_estimated"))


def hyp_cues(files: DataFrame, fmt: str | None = None) -> DataFrame:
    """Cues of files (path, raw). fmt: json, srt or md; else by suffix, and JSON for any other."""
    suffix = F.lower(F.regexp_extract("path", r"\.(srt|md)$", 1))
    kind = F.lit(fmt) if fmt else F.when(suffix == "", "json").otherwise(suffix)
    files = files.withColumn("fmt", kind)
    return json_cues(files.where("fmt = 'json'")).unionByName(srt_cues(files.where("fmt = 'srt'"))).unionByName(recap_cues(files.where("fmt = 'md'")), allowMissingColumns=True)


def load_hyp(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """hyp_cues() of the files at path."""
    return hyp_cues(whole_files(spark, path), fmt)


def vocab(files: DataFrame) -> DataFrame:
    """path, term: the lines of files (path, raw), without white space at their ends; blank ones are skipped."""
    return _numbered_lines(files).select("path", F.regexp_replace("line", r"^\s+|\s+$", "").alias("term")).where("term <> ''")


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """term, of the file at path."""
    return vocab(whole_files(spark, path)).select("term")


def level_bins(logs: DataFrame) -> DataFrame:
    """rec, bin_idx, rms_db, peak_db of logs (rec, raw); peaks that do not pair up are replaced by the RMS; a log without levels raises."""
    every = lambda p: F.transform(F.regexp_extract_all("raw", F.lit(p), F.lit(1)), clamped_db)
    rows = logs.select("rec", every(RMS).alias("rms"), every(PEAK).alias("peak"))
    rms = F.when(F.size("rms") > 0, F.col("rms")).otherwise(F.raise_error(F.concat(F.lit("no levels in the log of "), F.col("rec").cast("string"))).cast("array<double>"))
    peak = F.when(F.size("peak") == F.size("rms"), F.col("peak")).otherwise(F.col("rms"))
    return rows.select("rec", F.posexplode(F.arrays_zip(rms.alias("rms_db"), peak.alias("peak_db"))).alias("bin_idx", "x")).select("rec", F.col("bin_idx").cast("long").alias("bin_idx"), F.col("x")["rms_db"].alias("rms_db"), F.col("x")["peak_db"].alias("peak_db"))


def silences(logs: DataFrame) -> DataFrame:
    """rec, at: the middles of silences of logs (rec, raw), ascending in time; a start without an end is dropped."""
    every = lambda p: F.transform(F.regexp_extract_all("raw", F.lit(p), F.lit(1)), lambda x: x.cast("double"))
    both = F.arrays_zip(every(r"silence_start:\s*(-?[\d.]+)").alias("a"), every(r"silence_end:\s*(-?[\d.]+)").alias("b"))
    return logs.select("rec", F.explode(both).alias("x")).where("x.b > x.a").select("rec", ((F.col("x.a") + F.col("x.b")) / 2).alias("at"))


def source_files(spark: SparkSession, root: str, skip: tuple[str, ...] = (".git", "__pycache__", "node_modules", ".venv", "venv", "site-packages")) -> DataFrame:
    """path, content of the .py files below root, without the folders named in skip."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root).select("path", "content")
    inside: Column = F.lit(False)
    for name in skip:
        inside = inside | F.col("path").contains(f"/{name}/")
    return files.where(~inside)
