"""Merkle fixity audits of WARC files.

A record's bytes are hashed to a leaf. The leaves of a file, in the order of their offsets, are hashed by ranges of
`fanout` to the next level and so on up to one root a file; each node hashes the range of offsets that it covers, too. Each
replica has a tree over its own order. The trees are compared root by root; of files whose roots differ only the children of
differing nodes are compared, level by level, down to the records that are missing, extra or moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, ranked, scratch

FANOUT, FILE_RECORDS = 16, 1024
DRILL = 97  #: in op6, the replica's copies of the records with page_id divisible by this are damaged


def record(page_id: str = "page_id", url: str = "url", html: str = "html") -> Column:
    """A WARC/1.1 resource record as text; null fields are empty."""
    body = F.coalesce(F.col(html), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url), F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, *more: str) -> DataFrame:
    """page_id, n_bytes, leaf (SHA-256 of the record, hex) and the columns named by more."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), record().alias("r"), *more).select("page_id", F.octet_length("r").cast("long").alias("n_bytes"), F.sha2(F.encode("r", "UTF-8"), 256).alias("leaf"), *more)


def place(leaves_: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """leaves with file, slot and offset: records by page_id (null last; repeats by leaf), 1024 a file, so that no
    key, host or repeated id makes a file longer."""
    rows = ranked(leaves_, F.col("page_id").asc_nulls_last(), F.col("leaf"))
    rows = rows.withColumn("file", F.floor(F.col("rank") / file_records)).withColumn("slot", (F.col("rank") % file_records).cast("int"))
    before = Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("n_bytes").over(before), F.lit(0))).drop("rank")


def stored(pages: DataFrame) -> DataFrame:
    """page_id, n_bytes, leaf, file, slot, offset: where pages has file and offset, its records in that order, with these
    offsets; else as place() puts them."""
    if not {"file", "offset"} <= {*pages.columns}:
        return place(leaves(pages))
    rows = leaves(pages, "file", "offset")
    slot = F.row_number().over(Window.partitionBy("file").orderBy("offset", "page_id", "leaf")) - 1
    return rows.select("page_id", "n_bytes", "leaf", F.col("file").cast("long").alias("file"), slot.alias("slot"), F.col("offset").cast("long").alias("offset"))


def nodes(placed: DataFrame, longest: int = FILE_RECORDS, fanout: int = FANOUT) -> list[DataFrame]:
    """The tree of each file, leaves first: tables of file, slot, offset, n_bytes, hash; the last holds the roots of files of at
    most `longest` records. A node hashes the range of offsets that it covers (its offset and length) and, in order, its children."""
    hashed = lambda inner: F.sha2(F.concat_ws(":", "offset", "n_bytes", inner), 256).alias("hash")
    level = placed.select("file", "slot", "offset", "n_bytes", hashed("leaf"))
    out, width = [level], longest
    while width > 1:
        ordered = F.array_sort(F.collect_list(F.struct("slot", "hash")))
        inner = F.array_join(F.transform(ordered, lambda x: x["hash"]), "").alias("inner")
        level = level.groupBy("file", F.floor(F.col("slot") / fanout).cast("int").alias("up")).agg(F.min("offset").alias("offset"), F.sum("n_bytes").alias("n_bytes"), inner)
        level = cut(level.select("file", F.col("up").alias("slot"), "offset", "n_bytes", hashed("inner")))
        out.append(level)
        width = -(-width // fanout)
    return out


def _longest(*placed: DataFrame) -> int:
    return max(FILE_RECORDS, *((x.agg(F.max("slot")).first()[0] or 0) + 1 for x in placed))  # a file that is given may hold more


def compare(own: DataFrame, theirs: DataFrame, trees: tuple[list[DataFrame], list[DataFrame]], fanout: int = FANOUT) -> DataFrame:
    """One row per record that differs between two tables of stored(): finding, page_id, leaf, file, slot, offset (null if
    extra), other_file, other_slot, other_offset (null if missing). trees: their nodes(), of one height.

    finding: 'missing' (in own only), 'extra' (in theirs only) or 'moved' (the same bytes in another file, slot or at
    another offset). A record whose bytes were changed is missing and, as what it became, extra. Of records that are
    alike as many match as both have, first those in their place.
    """
    differ = None
    for a, b in zip(*(reversed(x) for x in trees), strict=True):  # from the roots down
        if differ is not None:  # below differing nodes only
            above = differ.select("file", F.col("slot").alias("up")).hint("merge")  # what differs may be much, so it is never broadcast
            a, b = (x.withColumn("up", F.floor(F.col("slot") / fanout).cast("int")).join(above, ["file", "up"], "left_semi") for x in (a, b))
        pair = a.select("file", "slot", F.col("hash").alias("one")).join(b.select("file", "slot", F.col("hash").alias("two")), ["file", "slot"], "full")
        differ = cut(pair.where(~F.col("one").eqNullSafe(F.col("two"))).select("file", "slot"))
        if differ.isEmpty():
            break
    alike = F.row_number().over(Window.partitionBy("page_id", "leaf").orderBy("file", "slot"))
    a, b = (x.join(differ.hint("merge"), ["file", "slot"], "left_semi").withColumn("nth", alike) for x in (own, theirs))
    b = b.select(*[F.col(x).alias(f"other_{x}") for x in ("page_id", "leaf", "nth", "file", "slot", "offset")])
    both = a.join(b, a["page_id"].eqNullSafe(b["other_page_id"]) & (a["leaf"] == b["other_leaf"]) & (a["nth"] == b["other_nth"]), "full")
    finding = F.when(F.col("other_leaf").isNull(), "missing").when(F.col("leaf").isNull(), "extra").otherwise("moved")
    return both.select(finding.alias("finding"), F.coalesce("page_id", "other_page_id").alias("page_id"), F.coalesce("leaf", "other_leaf").alias("leaf"), "file", "slot", "offset", "other_file", "other_slot", "other_offset")


@scratch
def differences(pages: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The rows of compare() for pages and replica (page_id, url, html; with file and offset, these are their places)."""
    own, theirs = cut(stored(pages)), cut(stored(replica))
    longest = _longest(own, theirs)
    return compare(own, theirs, (nodes(own, longest, fanout), nodes(theirs, longest, fanout)), fanout)


@scratch
def audit(pages: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row per record of `pages`: page_id, file, offset, n_bytes, leaf, root (of its file's tree), intact.

    pages, replica: page_id, url, html, and file and offset where their order is known; other columns are ignored. A record is
    intact unless compare() finds it missing: one that was only moved has all its bytes. What is moved or only in the replica is in
    differences(). Null fields are empty. Empty tables give no rows.
    """
    own, theirs = cut(stored(pages)), cut(stored(replica))
    longest = _longest(own, theirs)
    trees = nodes(own, longest, fanout), nodes(theirs, longest, fanout)
    bad = compare(own, theirs, trees, fanout).where("finding = 'missing'").select("file", "slot", F.lit(True).alias("_bad"))
    roots = trees[0][-1].select("file", F.col("hash").alias("root"))
    return own.join(bad.hint("merge"), ["file", "slot"], "left").join(roots.hint("merge"), "file").select("page_id", "file", "offset", "n_bytes", "leaf", "root", F.col("_bad").isNull().alias("intact"))


def op6_warc_audit(spark, sf_dir: str) -> DataFrame:
    """The pages against a replica in which some records are damaged: a drill whose answer is known."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return audit(pages, pages.withColumn("html", F.when(F.col("page_id") % DRILL == 0, F.concat(F.coalesce("html", F.lit("")), F.lit("?"))).otherwise(F.col("html"))))


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
         || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r
  FROM pages),
l AS (SELECT page_id, octet_length(encode(r))::BIGINT AS n_bytes, sha256(r) AS leaf FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY page_id, leaf) - 1 AS k FROM l),
f AS (SELECT *, k // 1024 AS file, k % 1024 AS slot FROM o),
g AS (SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY file ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_ FROM f),
z AS (SELECT file, slot, at_, n_bytes, sha256(at_ || ':' || n_bytes || ':' || leaf) AS h FROM g),
a AS (SELECT file, slot // 16 AS slot, min(at_) AS at_, sum(n_bytes)::BIGINT AS n_bytes, sha256(min(at_) || ':' || sum(n_bytes)::BIGINT || ':' || string_agg(h, '' ORDER BY slot)) AS h FROM z GROUP BY file, z.slot // 16),
b AS (SELECT file, slot // 16 AS slot, min(at_) AS at_, sum(n_bytes)::BIGINT AS n_bytes, sha256(min(at_) || ':' || sum(n_bytes)::BIGINT || ':' || string_agg(h, '' ORDER BY slot)) AS h FROM a GROUP BY file, a.slot // 16),
c AS (SELECT file, sha256(min(at_) || ':' || sum(n_bytes)::BIGINT || ':' || string_agg(h, '' ORDER BY slot)) AS root FROM b GROUP BY file)
SELECT page_id, file::BIGINT AS file, at_ AS "offset", n_bytes, leaf, root, page_id % 97 <> 0 AS intact FROM g JOIN c USING (file)"""
