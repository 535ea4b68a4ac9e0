"""Approximate nearest neighbours by score-aware (anisotropic) quantisation.

Unit vectors are cut into pairs of coordinates and each pair is stored as one of 16 centres: four bits. The
codes are chosen, and the centres fitted, for the loss that penalises a residual along its own vector more than
one across it, as only the former moves the large inner products. A search adds, for blocks of queries and
blocks of codes, one entry of a 16-entry table a pair. The length of a vector's residual bounds the error of that sum: every
vector whose sum plus bound reaches the query's k-th exact cosine so far is ranked by its own exact cosine, however many
there are, so the result is that of a search without codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, scratch

CENTRES, PAIR = 16, 2
SAMPLE = 20_000  #: vectors, at most, that the centres are fitted on
PARALLEL = 4.0  #: weight of the residual along the vector against that across
CODE_BLOCK, QUERY_BLOCK = 8192, 256
BLOCK_BYTES, GROUP_BYTES = 1 << 22, 1 << 26  #: of vectors, at most, in a block of codes and (about) in a group of blocks
ROUNDING = 1e-4  #: more than the sums of float32 entries are off
TIE = 1e-9  #: more than two ways of summing the same cosine differ
KEPT_QUERIES = 1 << 18  #: whose best a task holds before it passes them on


def _split(x: np.ndarray) -> np.ndarray:
    """Rows as (n, pairs, 2); an odd length gets a zero."""
    if x.shape[1] % PAIR:
        x = np.pad(x, ((0, 0), (0, 1)))
    return x.reshape(len(x), -1, PAIR)


def assign(x: np.ndarray, centres: np.ndarray, parallel: float = PARALLEL, rounds: int = 3) -> np.ndarray:
    """Codes (n, pairs) of unit rows x: first the nearest centres, then coordinate descent on the anisotropic loss
    |r|^2 + (parallel - 1) (r.x)^2, whose second part joins the pairs."""
    parts = _split(x)
    n, pairs, _ = parts.shape
    dist = np.stack([((parts[:, j, None, :] - centres[j][None]) ** 2).sum(-1) for j in range(pairs)], 1)
    along = np.stack([(parts[:, j, None, :] * (parts[:, j, None, :] - centres[j][None])).sum(-1) for j in range(pairs)], 1)
    code = dist.argmin(-1)
    total = np.take_along_axis(along, code[..., None], 2)[..., 0].sum(1)
    for _ in range(rounds):
        for j in range(pairs):
            rest = total - along[np.arange(n), j, code[:, j]]
            code[:, j] = (dist[:, j] + (parallel - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(-1)
            total = rest + along[np.arange(n), j, code[:, j]]
    return code


def fit(x: np.ndarray, parallel: float = PARALLEL, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Centres (pairs, 16, 2) for unit rows x: assignments by the anisotropic loss, then each pair's centres by least
    squares under that loss, the other pairs held."""
    parts = _split(x)
    n, pairs, _ = parts.shape
    rng = np.random.default_rng(seed)
    centres = np.stack([parts[rng.choice(n, CENTRES, replace=n < CENTRES), j] for j in range(pairs)])
    for step in range(rounds):
        weight = parallel if step > 1 else 1.0
        code = assign(x, centres, weight, 1)
        made = np.stack([centres[j][code[:, j]] for j in range(pairs)], 1)
        total = (parts * (parts - made)).sum((1, 2))
        for j in range(pairs):
            p = parts[:, j]
            rest = total - (p * (p - made[:, j])).sum(1)
            a = np.eye(PAIR)[None] + (weight - 1) * p[:, :, None] * p[:, None, :]
            b = p + (weight - 1) * ((p * p).sum(1) + rest)[:, None] * p
            for c in range(CENTRES):
                if (own := code[:, j] == c).any():
                    centres[j, c] = np.linalg.solve(a[own].sum(0) + 1e-9 * np.eye(PAIR), b[own].sum(0))
            made[:, j] = centres[j][code[:, j]]
            total = rest + (p * (p - made[:, j])).sum(1)
    return centres


def pack(code: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    if code.shape[1] % 2:
        code = np.pad(code, ((0, 0), (0, 1)))
    return (code[:, ::2] | code[:, 1::2] << 4).astype(np.uint8)


def scan(queries: np.ndarray, codes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries, rows) from packed codes: a table of 256 sums for each byte, of its two
    pairs' tables of 16."""
    table = np.einsum("qjd,jcd->qjc", _split(queries), centres).astype(np.float32)
    if table.shape[1] % 2:
        table = np.pad(table, ((0, 0), (0, 1), (0, 0)))
    both = (table[:, 1::2, :, None] + table[:, ::2, None, :]).reshape(len(queries), table.shape[1] // 2, 256)
    out = np.zeros((len(queries), len(codes)), np.float32)
    for j in range(codes.shape[1]):
        out += both[:, j, :][:, codes[:, j]]
    return out


def usable(vectors: DataFrame, size: int) -> DataFrame:
    """vec_id, unit (array<double>), of the rows whose vector has `size` finite components, not all zero."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = rows.where((F.size("v") == size) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where("vec_id is not null")
    most = F.array_max(F.transform("v", F.abs))  # scaled first, so that squares neither vanish nor overflow
    sound = sound.withColumn("m", most).where("m > 0").withColumn("v", F.expr("transform(v, x -> x / m)"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return sound.withColumn("n", norm).select("vec_id", F.expr("transform(v, x -> x / n)").alias("unit"))


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def residuals(x: np.ndarray, code: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Length of what the codes leave of each row."""
    made = np.stack([centres[j][code[:, j]] for j in range(code.shape[1])], 1)
    return np.sqrt(((_split(x) - made) ** 2).sum((1, 2)))


def _codes(centres: np.ndarray, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = _rows(part.column(1))
                code = assign(x, centres)
                made = (part.column(0).to_numpy(), pack(code), residuals(x, code, centres), x)
                yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()) for m in made], names=["ids", "codes", "errors", "vectors"])

    return run


def _queries(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([_rows(part.column(1)).tobytes()], pa.binary())], names=["query_ids", "queries"])

    return run


def improve(score: np.ndarray, near: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, approximate: np.ndarray, errors: np.ndarray) -> None:
    """Puts into score and near (queries, k), the best so far, what is better of a block of vectors; a place without a
    vector has the score -inf. No vector that can reach the k-th best is left out."""
    k = score.shape[1]
    upper = approximate + (errors + ROUNDING)
    upper[q_ids[:, None] == ids[None, :]] = -np.inf
    first = np.argpartition(-upper, min(k, len(ids)) - 1, axis=1)[:, :k]
    exact = np.einsum("qkd,qd->qk", vectors[first], queries)
    exact[np.isneginf(np.take_along_axis(upper, first, 1))] = -np.inf
    least = np.partition(np.concatenate([score, exact], 1), -k, axis=1)[:, -k]
    reach = (upper >= least[:, None] - TIE) & (upper > -np.inf)
    rows = np.flatnonzero(reach.any(0))
    if not len(rows):
        return
    exact = queries @ vectors[rows].T
    exact[~reach[:, rows]] = -np.inf
    least = np.partition(np.concatenate([score, exact], 1), -k, axis=1)[:, -k]
    reach = (exact >= least[:, None] - TIE) & (exact > -np.inf)
    for i in np.flatnonzero(reach.any(1)):
        own = rows[reach[i]]
        s, v = np.concatenate([score[i], (vectors[own] * queries[i]).sum(1)]), np.concatenate([near[i], ids[own]])
        order = np.lexsort((v, -s))[:k]
        score[i], near[i] = s[order], v[order]


def _best(centres: np.ndarray, k: int):
    def passed(best: dict) -> Iterator[pa.RecordBatch]:
        for key, (score, near) in best.items():
            there = np.isfinite(score)
            q = np.repeat(np.frombuffer(key, np.int64), there.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(near[there]), pa.array(score[there])], names=["query_id", "vec_id", "score"])
        best.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = {}, 0
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                vectors, queries = np.frombuffer(row["vectors"]).reshape(len(ids), -1), np.frombuffer(row["queries"]).reshape(len(q_ids), -1)
                if row["query_ids"] not in best:
                    if held + len(q_ids) > KEPT_QUERIES:
                        yield from passed(best)
                        held = 0
                    best[row["query_ids"]] = (np.full((len(q_ids), k), -np.inf), np.zeros((len(q_ids), k), np.int64))
                    held += len(q_ids)
                improve(*best[row["query_ids"]], q_ids, queries, ids, vectors, scan(queries, codes, centres), np.frombuffer(row["errors"]))
        yield from passed(best)

    return run


@scratch
def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (exact cosine): each query's k nearest among vectors but itself.

    vectors, queries: vec_id, embedding; others are ignored. Vectors that are null, zero, of another length
    than the most common one, or hold null or non-finite components take no part, nor do null ids. Ties go to the
    smaller vec_id. Rows that repeat a vec_id count once, by the first in the order of their components. Centres are fitted on
    at most SAMPLE vectors, those with the smallest hashes of vec_id; every vector is indexed and scanned.
    """
    lengths = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    if lengths is None or lengths["n"] == 0:
        return spark.createDataFrame([], empty)
    every = cut(usable(vectors, lengths["n"]).groupBy("vec_id").agg(F.min("unit").alias("unit")))
    asked = cut(usable(queries, lengths["n"]).groupBy("vec_id").agg(F.min("unit").alias("unit")))
    first = F.xxhash64("vec_id", F.lit("ann"))
    picked = F.broadcast(every.select("vec_id").orderBy(first).limit(SAMPLE))  # SAMPLE ids at most

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_rows(b.column(0)) for b in batches if b.num_rows]
        if parts:
            x = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([pa.array([fit(x[np.lexsort(x.T)]).tobytes()], pa.binary())], names=["centres"])

    model = every.join(picked, "vec_id").select("unit").repartition(1).mapInArrow(learn, "centres binary").first()
    if model is None:
        return spark.createDataFrame([], empty)
    centres = np.frombuffer(model["centres"]).reshape(-1, CENTRES, PAIR)
    # Every block of codes is in one of some groups, and each block of queries goes to every group.
    each = 8 * lengths["n"]
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-every.count() * each // GROUP_BYTES))
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    block = max(1, min(CODE_BLOCK, BLOCK_BYTES // each))
    codes = cut(every.mapInArrow(_codes(centres, block), "ids binary, codes binary, errors binary, vectors binary").withColumn("group", group))
    blocks = cut(asked.mapInArrow(_queries(QUERY_BLOCK), "query_ids binary, queries binary"))
    work = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(codes.hint("merge"), "group")
    scored = work.select("query_ids", "queries", "ids", "codes", "errors", "vectors").mapInArrow(_best(centres, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
