"""Shards of bounded bytes by extendible hashing, with DataFrame functions alone.

The directory is indexed by the leading bits of a record's hash. A bucket above the limit is split on
its next bit, and only such buckets are, until each holds at most `limit` bytes or one record. The
directory is made from one histogram of fine cells: the sums of siblings rise a few bits at a time, and what
fits below a bucket that does not becomes an entry. Only records of cells that are still too large are looked at again, with
more bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut, scratch

LIMIT = 1 << 20
BITS = 64
MAX_SPREAD = 4  #: bits of the first cells beyond those that equal shards would need
STRIDE = 4  #: bits by which sums rise at a time: a group holds 16 nodes at most
COPIES = 1 << 16  #: of rows that agree in everything, made from their count by one task


def _bits(prefix: str, hexed: str) -> str:
    return f"lpad(bin(cast(conv(substr({hexed}, {prefix}, 8), 16, 10) as bigint)), 32, '0')"


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digest, copy: rows that agree in the first three are counted and numbered anew, so a row's bits depend on what it
    holds and not on where it lay. No task makes more than COPIES of one row at a time."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.xxhash64(F.col("text").cast("string")).alias("digest"))
    rows = rows.groupBy("doc_id", "n_bytes", "digest").agg(F.count("*").alias("n"))
    each = lambda first, last: F.explode(F.sequence(first, last)).alias("copy")
    few = rows.where(F.col("n") <= COPIES).select("doc_id", "n_bytes", "digest", each(F.lit(0).cast("long"), F.col("n") - 1))
    many = rows.where(F.col("n") > COPIES).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("doc_id", "digest", "lot")
    return few.union(many.select("doc_id", "n_bytes", "digest", each(F.col("lot") * COPIES, F.least(F.col("n"), (F.col("lot") + 1) * COPIES) - 1)))


def _fits(n_bytes: Column, n: Column, limit: int) -> Column:
    return (n_bytes <= limit) | (n == 1)


def _entry(shard: Column, depth: int, n_bytes: Column, n: Column) -> Column:
    return F.struct(shard.alias("shard"), F.lit(depth).alias("depth"), n_bytes.alias("shard_bytes"), n.alias("shard_rows"))


def _own_entry(up: int, at: int, limit: int) -> Callable[[Column], Column]:
    """Of one of `kids`, prefixes of `at` bits that share `up`: the entry of its shortest prefix above `up` bits that fits."""

    def own(kid: Column) -> Column:
        found = []
        for depth in range(up + 1, at + 1):
            same = F.filter("kids", lambda x: F.substring(x["prefix"], 1, depth) == F.substring(kid["prefix"], 1, depth))  # noqa: B023
            n_bytes, n = (F.aggregate(F.transform(same, lambda x: x[c]), F.lit(0).cast("long"), lambda a, x: a + x) for c in ("bytes", "n"))  # noqa: B023
            found.append(F.when(_fits(n_bytes, n, limit), _entry(F.substring(kid["prefix"], 1, depth), depth, n_bytes, n)))
        return F.coalesce(*found)

    return own


def directory(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """cell, shard, depth, shard_bytes, shard_rows for cells (cell, bytes, n) of `high` bits in which each prefix
    shorter than `low` is known to be too large; shard is null where the cell itself is too large.

    A bucket that fits fits at every further bit, so a cell's shard is its shortest prefix that fits.
    """
    nodes, at, strides = cells.select(F.col("cell").alias("prefix"), "bytes", "n"), high, []
    while at > low:
        up = max(low, at - STRIDE)
        kids = nodes.groupBy(F.substring("prefix", 1, up).alias("up")).agg(F.collect_list(F.struct("prefix", "bytes", "n")).alias("kids"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        kids = cut(kids)

        own, large = _own_entry(up, at, limit), ~_fits(F.col("bytes"), F.col("n"), limit)
        strides.append(kids.select("up", F.explode(F.transform("kids", lambda x: F.struct(x["prefix"].alias("prefix"), F.when(large, own(x)).alias("entry")))).alias("x")).select("up", "x.prefix", "x.entry"))  # noqa: B023
        nodes, at = kids.select(F.col("up").alias("prefix"), "bytes", "n"), up
    found = nodes.select("prefix", F.when(_fits(F.col("bytes"), F.col("n"), limit), _entry(F.col("prefix"), low, F.col("bytes"), F.col("n"))).alias("entry"))
    for stride in reversed(strides):  # from the shortest prefixes down: what has no entry of its own has that of what it lies in
        above = found.select(F.col("prefix").alias("up"), F.col("entry").alias("above")).hint("merge")
        found = stride.join(above, "up").select("prefix", F.coalesce("entry", "above").alias("entry"))
    return found.select(F.col("prefix").alias("cell"), "entry.*")


@scratch
def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, shard, depth, shard_bytes, shard_rows.

    shard: the leading bits that the shard's records share. n_bytes: of the text in UTF-8, 0 for null. A
    record above the limit has a shard of its own. The first 32 bits hash the doc_id (null: the empty
    string), the rest also the text and, among equal rows, a number, so repeated rows split like any others and the
    shards do not depend on how the table lies. Other columns are ignored; an empty table gives no rows. Records that agree in all
    bits and are together above the limit raise ValueError.
    """
    name = "coalesce(cast(doc_id as string), '')"
    rows = cut(_numbered(docs).selectExpr("doc_id", "n_bytes", "digest", "copy", f"{_bits('1', f'md5({name})')} as head"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(32, max(1, math.ceil(math.log2(max(2, total / limit)))) + MAX_SPREAD)
    rows, out, low = rows.withColumn("bits", F.col("head")), [], 0
    for high in (depth, 32, 48, BITS):
        if high < low:
            continue
        if high > 32:
            tail = _bits("9", f"md5(concat({name}, ':', cast(digest as string), ':', cast(copy as string)))")
            rows = rows.withColumn("bits", F.concat("head", F.expr(tail)))
        rows = rows.withColumn("cell", F.substring("bits", 1, high))
        found = cut(directory(cut(rows.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))), low, high, limit))
        # The directory grows with the table, so it is never broadcast.
        out.append(rows.join(found.where("shard is not null").hint("merge"), "cell").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows"))
        left = found.where("shard is null").select("cell")
        if left.isEmpty():
            break
        rows = cut(rows.join(left.hint("merge"), "cell", "left_semi").drop("cell"))
        low = high + 1
    else:
        raise ValueError(f"records that agree in {BITS} bits are together above the limit of {limit} bytes")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT), 32, '0') AS bits
  FROM documents),
s AS (
  SELECT depth, substr(bits, 1, depth) AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows
  FROM d, (SELECT unnest(range(0, 33))::INT AS depth) GROUP BY ALL),
f AS (SELECT * FROM s WHERE shard_bytes <= 1048576 OR shard_rows = 1),
l AS (SELECT d.doc_id, d.n_bytes, min(f.depth) AS depth FROM d JOIN f ON f.shard = substr(d.bits, 1, f.depth) GROUP BY d.doc_id, d.n_bytes)
SELECT l.doc_id, l.n_bytes, f.shard, f.depth, f.shard_bytes, f.shard_rows
FROM l JOIN d USING (doc_id) JOIN f ON f.depth = l.depth AND f.shard = substr(d.bits, 1, f.depth)"""
