"""Document fingerprints by one-permutation MinHash, with DataFrame functions alone.

Every word shingle is hashed once; the leading bits of the hash choose one of 256 bins and a bin keeps its
smallest hash. An empty bin takes the value of the bin that its own sequence of hashes names first among
those filled (optimal densification). The low 8 bits of each bin are kept. Two fingerprints agree in a
bin with the chance J + (1 - J) / 256, which the estimate takes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut, ranked

BIN_BITS, LOW_BITS, SHINGLE = 8, 8, 5
BINS = 1 << BIN_BITS
TRIES = 10  #: bins that an empty bin looks at one by one, before all filled ones are put in its order at once


def with_bins(df: DataFrame, text: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """df with column `out`: the 256 bins' low bits as array<smallint>, empty for a text without words."""
    w, h, s, v = (f"__{out}_{x}" for x in "whsv")
    df = df.withColumn(w, F.expr(f"transform(filter(split(lower(coalesce({text}, '')), '[ \\\\t-\\\\r]+'), x -> x <> ''), x -> xxhash64(x))"))
    run = ", ".join(f"{w}[i + {j}]" for j in range(shingle))
    df = df.withColumn(
        h,
        F.expr(
            f"case when size({w}) >= {shingle} then transform(sequence(0, size({w}) - {shingle}), i -> shiftrightunsigned(xxhash64({run}), 1)) "
            f"when size({w}) > 0 then array(shiftrightunsigned(xxhash64({w}), 1)) else cast(array() as array<bigint>) end"
        ),
    )
    df = df.withColumn(s, F.sort_array(h))
    bin_of = lambda x: f"cast(shiftright({x}, {63 - BIN_BITS}) as int)"
    df = df.withColumn(s, F.expr(f"filter({s}, (x, i) -> i = 0 or {bin_of('x')} <> {bin_of(f'{s}[i - 1]')})"))
    gap = f"array_repeat(cast(null as bigint), {bin_of('x')} - (case when i = 0 then -1 else {bin_of(f'{s}[i - 1]')} end) - 1)"
    filled = f"flatten(transform({s}, (x, i) -> concat({gap}, array(x))))"
    df = df.withColumn(v, F.expr(f"case when size({s}) > 0 then concat({filled}, array_repeat(cast(null as bigint), {BINS - 1} - {bin_of(f'element_at({s}, -1)')})) end"))
    tries = ", ".join(f"{v}[cast(pmod(xxhash64(i, {a}), {BINS}) as int)]" for a in range(TRIES))
    last = f"array_min(transform({s}, x -> struct(xxhash64(i, {bin_of('x')}, 'order') as o, x as x))).x"
    low = f"transform({v}, (y, i) -> cast(coalesce(y, {tries}, {last}) & {(1 << LOW_BITS) - 1} as smallint))"
    return df.withColumn(out, F.expr(f"coalesce({low}, cast(array() as array<smallint>))")).drop(w, h, s, v)


def packed(bins: str) -> Column:
    """The bins' low bits as lowercase hex, two digits a bin."""
    return F.expr(f"array_join(transform({bins}, x -> substr(lower(hex(x + 256)), 2)), '')")


def likeness(a: str, b: str) -> Column:
    """The similarity (0 to 1) that two fingerprints show, freed of chance agreement. Two texts without words
    are alike, one without words and one with are not."""
    agree = F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), x -> x))") / F.lit(float(BINS))
    chance = 1.0 / (1 << LOW_BITS)
    some = F.greatest(F.lit(0.0), (agree - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(some)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with its fingerprint as hex; other columns stay."""
    return with_bins(docs, text, "__bins").withColumn(out, packed("__bins")).drop("__bins")


def edited(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text keeps the first half and takes the rest from the start of the document with the next smaller
    doc_id (after the last: the first; alone: itself). Null text is empty. A null doc_id comes last in that
    order. Where rows repeat a doc_id, each gets its row and the smallest text stands for all as a neighbour.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = cut(docs.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.length("text")).alias("most")))
    place = cut(ranked(ids, F.col("doc_id").desc_nulls_last()))
    n = max(1, place.count())
    after = place.select(F.pmod(F.col("rank") - 1, F.lit(n)).alias("rank"), F.col("doc_id").alias("next_id"))
    links = place.join(after, "rank").select(F.col("doc_id").alias("own_id"), "next_id", F.floor(F.col("most") / 2).cast("int").alias("need"))
    repeated = ids.where("rows > 1").limit(1).count() > 0
    own = with_bins(docs, "text", "bins")
    near = with_bins(docs.groupBy("doc_id").agg(F.min("text").alias("text")), "text", "bins") if repeated else own
    links = links.hint("shuffle_hash")
    pieces = near.join(links, near["doc_id"].eqNullSafe(links["next_id"])).select("own_id", F.substring("text", F.lit(1), F.col("need")).alias("piece"), F.col("bins").alias("next_bins"))
    rows = own.join(pieces, own["doc_id"].eqNullSafe(pieces["own_id"])).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    new = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("piece", F.lit(1), half))
    rows = with_bins(rows.withColumn("new", new), "new", "new_bins")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("new", "UTF-8"), 256).alias("edited_sha256"),
        packed("bins").alias("fingerprint"),
        packed("new_bins").alias("edited_fingerprint"),
        likeness("bins", "new_bins").alias("near_edited"),
        likeness("bins", "next_bins").alias("near_next"),
    )


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
