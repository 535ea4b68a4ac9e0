"""Mixing sources to target weights by capped water-filling.

Every source gets its weight's share of the whole; a source whose share is above `cap` times its size is
clamped there and the rest is shared again by weight among the others, until no share is above. A
document is taken as often as whole epochs ask for; the fractional epoch takes documents in seeded order
until the source's target is met, so a source misses its target by less than one document.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, local, ranked

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix-1"
WORDS = r"[^\x20\x09-\x0D]+"
FEW_SOURCES = 20_000  #: tables of at most so many sources are broadcast
ROWS_A_SLICE = 2000  #: rows of a source, about, that are put in order together


def size_of(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[int], cap: int = CAP) -> list[float]:
    """The targets of sources of these sizes and weights."""
    clamped, total = [False] * len(sizes), sum(sizes)
    while True:
        rest = total - cap * sum(n for n, c in zip(sizes, clamped, strict=True) if c)
        weight = sum(w for w, c in zip(weights, clamped, strict=True) if not c) or 1
        more = [c or cap * n * weight < w * rest for n, w, c in zip(sizes, weights, clamped, strict=True)]
        if more == clamped:
            return [float(cap * n) if c else float(w * rest) / float(weight) for n, w, c in zip(sizes, weights, clamped, strict=True)]
        clamped = more


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources (source, source_size) with target: weights repeat over the sources by code point, null last.

    A table of few sources is filled at once on the driver. Of more, two sums come to the driver in each round; the loop ends, as each round
    clamps a source.
    """
    if len(few := sources.limit(FEW_SOURCES + 1).collect()) <= FEW_SOURCES:
        few.sort(key=lambda x: (x.source is None, (x.source or "").encode("utf-8", "surrogatepass")))
        target = water_fill([x.source_size for x in few], [weights[i % len(weights)] for i in range(len(few))], cap)
        return local(sources.sparkSession, source=pa.array([x.source for x in few], pa.string()), source_size=pa.array([x.source_size for x in few], pa.int64()), target=pa.array(target, pa.float64()))
    order = ranked(sources, F.col("source").asc_nulls_last())
    state = order.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")).withColumn("clamped", F.lit(False))
    total = None
    while True:
        free = ~F.col("clamped")
        got = state.agg(F.sum("source_size").alias("all"), F.sum(F.when(~free, F.col("source_size"))).alias("held"), F.sum(F.when(free, F.col("weight"))).alias("weight"), F.sum(F.col("clamped").cast("long")).alias("n")).first()
        total = (got["all"] or 0) if total is None else total
        rest, weight = total - cap * (got["held"] or 0), got["weight"] or 1
        share = F.col("weight") * F.lit(rest) / F.lit(weight)
        state = cut(state.withColumn("clamped", F.col("clamped") | (cap * F.col("source_size") * F.lit(weight) < F.col("weight") * F.lit(rest))))
        if (state.agg(F.sum(F.col("clamped").cast("long"))).first()[0] or 0) == (got["n"] or 0):
            return state.withColumn("target", F.when(F.col("clamped"), (cap * F.col("source_size")).cast("double")).otherwise(share.cast("double"))).drop("rank", "weight", "clamped")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs (doc_id, text, source and any others) with mix_size, mix_source_size, mix_target, mix_times.

    mix_times: how often the mix takes the document, at most `cap`. Null text has size 0; a null source is a
    source; an empty table gives an empty table; rows that repeat a doc_id are taken separately, and those that
    agree in everything may swap their times. Columns of docs named mix_* are replaced; others may have any name.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_times")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    base = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)], F.col("source").cast("string").alias("source"), size_of().alias("size"), key.alias("key"))
    narrow = cut(base.select("source", "size", "key"))
    sources = cut(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    few = sources.count() <= FEW_SOURCES
    rows_of = sources.select(F.col("source").alias("_source"), "rows")
    bits = F.least(F.lit(20), F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / ROWS_A_SLICE)).cast("int")))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    table = targets(sources.select("source", "source_size"), weights, cap)
    table = table.join(rows_of, table["source"].eqNullSafe(rows_of["_source"])).withColumn("shift", 20 - bits).withColumn("whole", whole.cast("long"))
    table = cut(table.select("_source", "source_size", "target", "shift", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest")))

    def placed(df: DataFrame) -> DataFrame:
        t = F.broadcast(table) if few else table
        at = F.expr("shiftright(cast(conv(substr(key, 1, 5), 16, 10) as bigint), shift)")
        return df.join(t, df["source"].eqNullSafe(t["_source"]), "left").withColumn("slice", at)

    slices = placed(narrow).groupBy("_source", "slice").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    run = Window.partitionBy("_source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = slices.withColumn("end", F.sum("n").over(run)).withColumn("before", F.col("end") - F.col("n"))
    state = F.when(F.col("end") <= F.col("rest"), 1).when(F.col("before") > F.col("rest"), 0).otherwise(2)
    slices = cut(slices.select(F.col("_source").alias("_s"), F.col("slice").alias("_i"), "before", state.alias("state")))
    rows = placed(base)
    rows = rows.join(slices, rows["_source"].eqNullSafe(slices["_s"]) & (rows["slice"] == slices["_i"]), "left")
    order = Window.partitionBy("_source", "slice").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where("state = 2").withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn("state", (2 * F.col("before") + F.col("size") <= 2 * F.col("rest")).cast("int"))
    rows = rows.where("state is null or state <> 2").unionByName(edge)
    extra = F.when((F.col("whole") < cap) & (F.col("size") > 0), F.coalesce("state", F.lit(0))).otherwise(0)
    return rows.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), (F.col("whole") + extra).cast("long").alias("mix_times"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_times") * F.col("mix_size")).alias("taken"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
o AS (
  SELECT *, sum(source_size) OVER ()::BIGINT
            - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS r,
         sum(w) OVER (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS wr
  FROM w),
c AS (SELECT *, 3 * source_size * wr < w * r AS clamped FROM o),
f AS (SELECT coalesce(max_by(r, wr) FILTER (NOT clamped), 0) AS r, coalesce(max(wr) FILTER (NOT clamped), 1) AS wr FROM c),
t AS (SELECT c.source, source_size, CASE WHEN clamped THEN (3 * source_size)::DOUBLE ELSE (w * f.r)::DOUBLE / f.wr::DOUBLE END AS target FROM c, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS whole FROM t),
p AS (
  SELECT d.doc_id, d.size, e.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN whole < 3 AND size > 0 AND 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p"""
