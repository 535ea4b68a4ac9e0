"""Near-duplicate documents by SetSketch registers.

Each document's set of word shingles becomes M registers: an element's M points lie one in each of M
strata of the exponential distribution (ascending, so most elements stop early), a register keeps the
smallest point dealt to it, and the value kept is its logarithm to the base B, cut to 16 bits. Registers
of a union are the maxima of the registers. Bands of registers propose pairs, the registers' joint
likelihood weighs them, and the full sets decide.

Groups of equal sets enter as one row. In a band's bucket every member is first compared with one hub, the
member that meets most others; afterwards only members whose components still differ, and which share enough
shingles with others at all, are compared. So a large group of near copies costs about one comparison a member
and band, not one a pair. A group whose members lie just below the threshold has no such shortcut: its members are
compared within pairs of blocks of bounded size, registers first and then full sets, each pair in the first band alone that it
shares, and a pair of blocks yields no more links than join its components. That work grows with the square of such a group; the rows made and a task's memory do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import components, cut, scratch
from .text import U64, blocks, distinct, mix, shingles, trimmed, words

M, BANDS, ROWS = 163, 40, 4  #: M is prime: every step deals an element's points to all registers
BLOCK, BLOCK_SHINGLES = 512, 1 << 17  #: about so many members and shingles a block
BASE, RATE, TOP = 1.001, 20.0, 65534


def minima(doc: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """The smallest of the stratified points dealt to each register; 1 where there is none."""
    least = np.ones(docs * M)
    index, step = (h % U64(M)).astype(np.int64), (1 + (h >> U64(32)) % U64(M - 1)).astype(np.int64)
    base = doc * M
    for j in range(M):
        point = (j + (mix(h + U64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> U64(11)).astype(np.float64) * 2.0**-53) / M
        np.minimum.at(least, base + index, point)
        open_ = least.reshape(docs, M).max(axis=1) > (j + 1) / M
        keep = open_[doc]
        doc, h, base, step = doc[keep], h[keep], base[keep], step[keep]
        if len(doc) == 0:
            break
        index = index[keep] + step
        index[index >= M] -= M
    return least.reshape(docs, M)


def registers(least: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(-np.log1p(-least) / RATE) / np.log(BASE))
    return np.clip(np.nan_to_num(value, neginf=0), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def bands(regs: np.ndarray) -> np.ndarray:
    part = regs[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(U64)
    key = np.zeros(part.shape[:2], U64)
    for r in range(ROWS):
        key = (key << U64(16)) | part[:, :, r]
    return mix(key ^ mix(np.arange(BANDS, dtype=U64) + U64(77))[None, :]).view(np.int64)


def _log_p(x: np.ndarray) -> np.ndarray:
    """P(one register above the other), to the base B."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def likelihood(above: np.ndarray, below: np.ndarray, u: np.ndarray, jaccard: np.ndarray) -> np.ndarray:
    """log-likelihood of the similarity, given how many of M registers are above and below; u: the first
    set's share of the sum of both sizes."""
    v, equal = 1 - u, M - above - below
    p, q = _log_p(u - v * jaccard), _log_p(v - u * jaccard)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(n > 0, n * np.log(np.maximum(x, 1e-300)), 0.0) for n, x in ((above, p), (below, q), (equal, 1 - p - q))]
    return parts[0] + parts[1] + parts[2]


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(similarity of the greatest likelihood, that log-likelihood, u); rows of registers and set sizes."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u = n_a / (n_a + n_b)
    low, high = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    golden = (5**0.5 - 1) / 2
    for _ in range(30):  # the log-likelihood is concave in the similarity
        x, y = high - golden * (high - low), low + golden * (high - low)
        left = likelihood(above, below, u, x) > likelihood(above, below, u, y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    best = (low + high) / 2
    return best, likelihood(above, below, u, best), u


def _sketches(threshold_words: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in blocks(text):
                w = words(data, offsets, lower=True)
                doc, h = distinct(*shingles(w.hashes(), w.first, threshold_words))
                n = np.bincount(doc, minlength=hi - lo)
                regs = registers(minima(doc, h, hi - lo))
                sign = np.zeros((hi - lo, 2), U64)
                np.add.at(sign[:, 0], doc, mix(h ^ U64(0xA5A5A5A5A5A5A5A5)))
                np.add.at(sign[:, 1], doc, mix(h + U64(0x1234567)))
                key = bands(regs)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(n, pa.int64()),
                        pa.array([x.tobytes() for x in sign], pa.binary()),
                        pa.array([x.tobytes() for x in regs], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * BANDS, pa.int32()), pa.array(key.ravel(), pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "sign", "registers", "bands"],
                )

    return run


def sketch(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """doc_id, n_shingles, sign (16 bytes that equal sets share), registers, bands (one key each)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _sketches(shingle_words), "doc_id long, n_shingles long, sign binary, registers binary, bands array<long>"
    )


def _sets(shingle_words: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                w = words(data, offsets, lower=True)
                doc, h = distinct(*shingles(w.hashes(), w.first, shingle_words))
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=hi - lo))])
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), column], names=["rep", "shingles"])

    return run


def _weigh(threshold: float, slack: float):
    """Drops the pairs whose likelihood at the threshold lies `slack` below the greatest, where that is
    reached below the threshold. slack 18 is six standard deviations."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            regs = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, M) for i in (2, 3)]
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (4, 5))
            best, most, u = estimate(*regs, n_a, n_b)
            most_possible = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
            above, below = (regs[0] > regs[1]).sum(axis=1), (regs[0] < regs[1]).sum(axis=1)
            at = likelihood(above, below, u, np.full(len(u), threshold))
            keep = (most_possible >= threshold - 1e-9) & ((best >= threshold) | (most - at <= slack))
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


@trimmed
def _sketched_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, registers, shingles, from rep, shingles."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            column = part.column(1)
            size = np.diff(column.offsets.to_numpy())
            h = column.flatten().to_numpy(zero_copy_only=False).view(U64)
            regs = registers(minima(np.repeat(np.arange(len(size)), size), h, len(size)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in regs], pa.binary()), column], names=["rep", "registers", "shingles"])


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float, slack: float) -> np.ndarray:
    """Which pairs remain: as in _weigh(), but one trial likelihood below the threshold stands for the greatest, so a few
    more remain; rows of registers and set sizes."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u = n_a / (n_a + n_b)
    high = np.minimum(u / (1 - u), (1 - u) / u)
    trial = np.minimum((M - above - below) / M, high)
    far = likelihood(above, below, u, trial) - likelihood(above, below, u, np.full(len(u), threshold)) > slack
    return (high >= threshold - 1e-9) & ~((trial < threshold) & far)


def earlier_bands(regs: np.ndarray, key: int) -> np.ndarray:
    """The members' keys in the bands before that of a bucket's key; of a pair that agrees in one of them, the bucket of that band
    decides. A member whose registers do not have the key (another text under its doc_id) has no part in finding the band."""
    keys = bands(regs)
    at = np.flatnonzero((keys == key).any(axis=0))
    return keys[:, : at[0]] if len(at) else keys[:, :0]


def block_links(side, component, own, regs, shingles: list[np.ndarray], cross: bool, percent: int, slack: float, key: int | None = None) -> list[tuple[int, int]]:
    """Links (rows of the arguments) that join the components of the members of one block, or of two (cross: sides 0 and 1),
    as all links of 100 * intersection >= percent * union between them would. key: of the bucket; pairs that share an earlier one are
    left to it."""
    before = earlier_bands(regs, key) if key is not None else np.zeros((len(regs), 0), np.int64)
    size = np.array([len(x) for x in shingles])
    start = np.concatenate([[0], np.cumsum(size)])
    vocabulary, code = np.unique(np.concatenate(shingles), return_inverse=True)
    mark, component, shared, out = np.zeros(len(vocabulary), bool), component.copy(), size - own, []
    for i in np.flatnonzero(side == 0) if cross else range(len(size) - 1):
        can = (component != component[i]) & ((100 + percent) * np.minimum(shared, shared[i]) >= percent * (size + size[i]))
        j = np.flatnonzero(can & (side == 1) if cross else can & (np.arange(len(size)) > i))
        if len(j) and before.shape[1]:
            j = j[~(before[j] == before[i]).any(axis=1)]
        if len(j):
            j = j[plausible(np.broadcast_to(regs[i], (len(j), M)), regs[j], np.full(len(j), float(size[i])), size[j].astype(float), percent / 100, slack)]
        if len(j) == 0:
            continue
        mark[code[start[i] : start[i + 1]]] = True
        first = np.concatenate([[0], np.cumsum(size[j])[:-1]])
        place = np.repeat(start[j] - first, size[j]) + np.arange(size[j].sum())
        common = np.add.reduceat(mark[code[place]].astype(np.int64), first)
        mark[code[start[i] : start[i + 1]]] = False
        j = j[100 * common >= percent * (size[i] + size[j] - common)]
        joined, one = np.unique(component[j], return_index=True)
        out += [(int(i), int(x)) for x in j[one]]
        component[np.isin(component, joined)] = component[i]
    return out


def _within_blocks(percent: int, slack: float):
    """(a, b): the links of block_links() for each row key, lo, hi, members."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            for row in range(batch.num_rows):
                (key, lo, hi), members = (batch.column(i)[row].as_py() for i in range(3)), batch.column(3).slice(row, 1).flatten()
                side, rep, component, own = (members.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                if len(rep) < 2:
                    continue
                regs = np.frombuffer(b"".join(members.field(4).to_pylist()), np.uint16).reshape(len(rep), M)
                sets, at = members.field(5), members.field(5).offsets.to_numpy()
                values = sets.values.to_numpy(zero_copy_only=False)
                shingles_ = [values[at[i] : at[i + 1]] for i in range(len(rep))]
                if links := block_links((side == hi).astype(int) if lo < hi else side, component, own, regs, shingles_, lo < hi, percent, slack, key):
                    found.append(rep[np.array(links)])
            pairs = np.sort(np.concatenate(found or [np.zeros((0, 2), np.int64)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

    return run


@scratch
def near_duplicates(docs: DataFrame, percent: int = 75, shingle_words: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    docs: doc_id, text; other columns are ignored. Documents with 100 * intersection >= percent * union
    of their shingle sets are linked; component_id is the smallest doc_id reachable and kept marks the
    document that bears it. Null and empty texts, and texts without words, have size 0 and stand alone.
    Rows with a null doc_id are returned with a null component_id and kept. Rows that repeat a doc_id
    are one node; each row is returned with its own size.

    A pair at the very threshold is proposed by at least one of 40 bands of 4 registers with a chance of
    1 - 3e-7, nearer ones with more; no pair that is proposed is dropped but by its likelihood (six standard
    deviations) or its full sets.
    """
    whole = cut(sketch(docs, shingle_words))
    sized = whole.where("n_shingles > 0 and doc_id is not null")
    groups = cut(sized.groupBy("sign", "n_shingles").agg(F.min("doc_id").alias("rep")))
    member = sized.select("doc_id", "sign", "n_shingles").join(groups, ["sign", "n_shingles"]).select("doc_id", "rep").distinct()
    reps = groups.select("rep", "sign", "n_shingles").join(
        sized.select(F.col("doc_id").alias("rep"), "sign", "n_shingles", "registers", "bands"), ["rep", "sign", "n_shingles"]
    )
    keys = reps.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key", "n")
    inside = cut(keys.join(cut(shared), "key"))  # what meets nothing ends here; shared as a table, so that the join can split a large bucket
    drawn = inside.groupBy("rep").agg(F.sum("n").alias("drawn"))
    inside = cut(inside.join(drawn, "rep").select("key", "rep", "drawn"))
    hubs = inside.groupBy("key").agg(F.max(F.struct("drawn", (-F.col("rep")).alias("back"))).alias("hub")).select("key", (-F.col("hub.back")).alias("hub"))
    first = inside.join(cut(hubs), "key").where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()

    facts = reps.select("rep", "registers", "n_shingles").distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))

    # The full sets of all that share a bucket: the texts are dealt once, for both rounds.
    # The other side grows with the documents, so it is never broadcast: the plan is the same at every size.
    sets = cut(text.join(inside.select("rep").distinct().hint("merge"), "rep", "left_semi").mapInArrow(_sets(shingle_words), "rep long, shingles array<long>"))

    def weighed(pairs: DataFrame) -> DataFrame:
        side = lambda x: facts.select(F.col("rep").alias(x), F.col("registers").alias(f"r_{x}"), F.col("n_shingles").alias(f"n_{x}")).hint("merge")
        return cut(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "r_a", "r_b", "n_a", "n_b").mapInArrow(_weigh(percent / 100, 18.0), "a long, b long").distinct())

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda x: sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"s_{x}")).hint("merge")
        common = F.size(F.array_intersect("s_a", "s_b"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", common)
        return cut(both.where(100 * F.col("common") >= percent * (F.size("s_a") + F.size("s_b") - F.col("common"))).select("a", "b").distinct())

    first = cut(first)
    same = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").join(member, "doc_id")
    links = confirmed(weighed(first)).union(same.select("a", F.col("rep").alias("b")))  # a repeated doc_id is one node
    found = components(links)
    # What a bucket still holds of several components is compared in full. A set links with another only if they share
    # percent / (100 + percent) of both sizes' sum, and it shares no shingle that no other set of these buckets has: so
    # edits of its own exclude a far copy from all its pairs at once.
    def mixed(rows: DataFrame) -> DataFrame:
        keys = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("small").alias("least"), F.count("*").alias("members"), F.sum("n").alias("held")).where("low < high")
        return rows.drop("least", "members", "held").join(keys.select("key", "least", "members", "held"), "key")

    sizes = facts.groupBy("rep").agg(F.max("n_shingles").alias("n"), F.min("n_shingles").alias("small"))
    state = inside.select("key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    state = cut(mixed(state.join(sizes, "rep")))
    left = sets.join(state.select("rep").distinct().hint("merge"), "rep", "left_semi")
    alone = left.select("rep", F.explode("shingles").alias("x")).groupBy("x").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).where("c = 1").groupBy("rep").agg(F.count("*").alias("own"))
    alone = alone.join(sets.groupBy("rep").count().where("count > 1"), "rep", "left_anti")  # texts that share a doc_id: no bound
    part = state.join(alone, "rep", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    part = part.where((100 + percent) * (F.col("n") - F.col("own")) >= percent * (F.col("n") + F.col("least")))
    part = cut(mixed(part).select("key", "rep", "component", "own", "members", "held"))
    bodies = sets.join(part.select("rep").distinct().hint("merge"), "rep", "left_semi").mapInArrow(_sketched_sets, "rep long, registers binary, shingles array<long>")
    parts = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("int")
    dealt = part.withColumn("side", F.pmod(F.xxhash64("rep", F.lit(7)), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "rep", "side", "component", "own").join(bodies.hint("merge"), "rep")
    packed = dealt.groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("side", "rep", "component", "own", "registers", "shingles")).alias("members")).select("key", "lo", "hi", "members")
    more = cut(packed.mapInArrow(_within_blocks(percent, 18.0), "a long, b long").distinct())
    if not more.isEmpty():
        found = components(links.union(more))
    final = member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("label"))
    final = final.groupBy("doc_id").agg(F.min("label").alias("label"))
    out = whole.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    component = F.coalesce("label", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
