"""A corpus pipeline over `documents`: toxicity, near-dedup, substring dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir); run() writes its rows as Parquet and reads them again for the next. All but
the last return the columns of documents. Learning aside, which reads labels, a stage sees only its input. Extra columns
of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm import bpe, minhash, mixing, substring, toxicity
from scrivener.llm.store import cut, ranked, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _row, a key of each row in the order of doc_id (null last), then of the other columns. Only rows whose doc_id is null
    or repeated are dealt anew, unless the ids leave no bits for their places."""
    key = F.col("doc_id").cast("long")
    odd = cut(docs.groupBy(key.alias("_id")).count().where("_id is null or count > 1"))
    rows = odd.agg(F.sum("count")).first()[0]
    if not rows:
        return docs.withColumn("_row", key)
    order = (F.col("doc_id").asc_nulls_last(), F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars"))
    low, high = docs.agg(F.min(key), F.max(key)).first()
    most, bits = max(-(low or 0), high or 0) + 1, rows.bit_length()
    if most.bit_length() + bits > 62:
        return cut(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    some = cut(ranked(docs.join(odd, key.eqNullSafe(odd["_id"]), "left_semi"), *order))
    first = some.groupBy(key.alias("_id")).agg(F.min("rank").alias("_first"))
    some = some.join(first, key.eqNullSafe(first["_id"])).withColumn("_row", F.coalesce(key, F.lit(most)) * F.lit(1 << bits) + F.col("rank") - F.col("_first"))
    rest = docs.join(odd, key.eqNullSafe(odd["_id"]), "left_anti").withColumn("_row", key * F.lit(1 << bits))
    return rest.select(*COLUMNS, "_row").union(some.select(*COLUMNS, "_row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose own toxicity score is below the threshold, whatever other rows their doc_id has."""
    docs = docs.select(*COLUMNS)
    return toxicity.clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id (null last), of those the one with the smallest text. Rows that
    share a doc_id, or have none, are near duplicates only if their sets link."""
    docs = _keyed(docs.select(*COLUMNS))
    gone = cut(minhash.near_duplicates(docs.select(F.col("_row").alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias("_row")))
    return docs.join(gone, "_row", "left_anti").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the words that windows of an earlier row cover, earlier by doc_id. Rows that lose nothing keep their text
    as it is; the others keep the rest of their words, joined by one space, down to an empty text."""
    docs = _keyed(docs.select(*COLUMNS))
    facts, removals = substring.repeated(docs.select(F.col("_row").alias("doc_id"), "text"))
    changed = facts.where("copy").select("doc_id", F.lit("").alias("kept")).union(removals.select("doc_id", "kept"))
    changed = changed.groupBy(F.col("doc_id").alias("_row")).agg(F.min("kept").alias("_kept"))
    rows = docs.join(changed, "_row", "left").withColumn("text", F.coalesce("_kept", "text"))
    return rows.withColumn("n_chars", F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those that it takes no time are gone. A document without words has no
    share in the mix and stays once."""
    rows = mixing.mix(docs.select(*COLUMNS))
    times = F.when(F.col("mix_size") == 0, F.lit(1)).otherwise(F.col("mix_times")).cast("int")
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), times))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256, decoded_sha256 of every row."""
    coded = bpe.encode(docs)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learning, graph closure and BPE are beyond SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


@scratch
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages wrote before is deleted when they are there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
