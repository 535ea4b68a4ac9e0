"""An annotation store: versions of golden lines in a directory each, the last ten kept."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.operators.validate import line_errors

KEEP, EXAMPLE = 10, "（範例"


def _fs(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> list[str]:
    """Complete versions, oldest first."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()]
    jvm = spark.sparkContext._jvm
    return sorted(n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS")))


def save(lines: DataFrame, root: str, manifests: DataFrame | None = None, keep: int = KEEP, shown: int | None = None) -> list[str]:
    """Writes lines (set_id, ord, raw) as a new version unless they are empty or break their schema; returns the errors, all of them
    or the first `shown` and their number.

    A version counts once its _SUCCESS file is there, so a reader never sees half of one. One writer at a time."""
    if lines.isEmpty():
        return ["an empty list is not written"]
    errors = line_errors(lines, manifests).orderBy("set_id", "ord", "error")
    if bad := [f"{x.set_id}, line {x.ord}: {x.error}" for x in (errors if shown is None else errors.limit(shown)).collect()]:
        return bad + ([f"the first {shown} of {n} errors; all are in line_errors()"] if len(bad) == shown and (n := errors.count()) > shown else [])
    spark = lines.sparkSession
    lines.write.parquet(f"{root}/v={time.time_ns():020d}")
    fs, _ = _fs(spark, root)
    for old in versions(spark, root)[:-keep]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{old}"), True)
    return []


def read(spark: SparkSession, root: str) -> DataFrame:
    """The latest version, without example lines."""
    there = versions(spark, root)
    if not there:
        return spark.createDataFrame([], "set_id string, ord int, raw string")
    return without_examples(spark.read.parquet(f"{root}/{there[-1]}"))


def without_examples(lines: DataFrame) -> DataFrame:
    """lines (raw JSON) but those whose text is marked as an example."""
    return lines.where(~F.coalesce(F.get_json_object("raw", "$.zh"), F.lit("")).contains(EXAMPLE))


def next_ids(lines: DataFrame) -> DataFrame:
    """set_id, seg, next_id for lines (set_id, seg, id): one above the largest number, three digits."""
    number = F.regexp_extract("id", r"(\d+)$", 1).try_cast("int")
    return lines.groupBy("set_id", "seg").agg(F.concat("seg", F.lit("-"), F.lpad((F.coalesce(F.max(number), F.lit(0)) + 1).cast("string"), 3, "0")).alias("next_id"))
