"""Substring dedup: words covered by a window of `width` words that also starts in an earlier document.

Windows are dealt to shards by content: a window's anchor is the run of five words in it whose hash is
smallest, so equal windows share an anchor. Runs of windows with one anchor are segments. Anchors met in one document
only end there. Of the rest, each shard holds its distinct segments in a compressed FM-index: the Burrows-Wheeler
transform in a wavelet tree of packed bits, and the documents of those suffixes alone that a window can match. The documents'
segments stream against it, equal ones once; backward search gives their matching statistics, which are the lengths of the longest
ends that another segment of the shard holds, too, and of the intervals that reach `width` the smallest doc_id decides.

A large group never meets in one task: within a batch an anchor shared by several documents is settled
there, and only one entry a batch and anchor goes on; equal segments of a batch are one row; the segments of an anchor
that more than HOT have are cut into single windows, which are dealt by all their words. Shards and parts are made so many that
each holds a bounded number of bytes. Every step that shuffles words, keys or texts ends in a table, so that the disk holds the shuffle
files of one step at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, scratch, settled, tidy
from .text import U64, Words, blocks, mix, trimmed, words

WIDTH, ANCHOR = 13, 5
PART_BYTES = 1 << 25  #: about so many bytes of entries a part, and of words a shard
LOTS = 4  #: parts and shards a partition, as they fall to partitions by hash
HOT = 1 << 12  #: segments of an anchor; those of an anchor with more are cut into windows
HOT_ANCHORS = 1 << 20  #: at most so many anchors count as hot, as each task gets their list; HOT grows instead
_STEP = U64(0x9FB21C651E98DF25)
_POWER = np.multiply.accumulate(np.full(ANCHOR, _STEP, U64))


class FMIndex:
    """A compressed FM-index over many sequences of positive integers; 0 ends each sequence.

    Symbols are renamed by rank. Each level of the wavelet tree (in matrix form) keeps one bit a symbol, packed by 64, and
    the ones before each word of bits. Neither the text nor the suffix array is kept: of the suffixes with at least `width` symbols,
    marked by packed bits, the sequence is, so that intervals of patterns of that length can be resolved.
    """

    def __init__(self, text: np.ndarray, width: int = 1):
        """text: the sequences' symbols (uint64), each sequence followed by a 0."""
        self.names, symbol = np.unique(text, return_inverse=True)
        if not len(self.names) or self.names[0] != 0:
            self.names, symbol = np.append(np.zeros(1, text.dtype), self.names), symbol + 1
        self.n, self.width = len(symbol), width
        suffix = self._suffixes(symbol)
        self.first = np.searchsorted(np.sort(symbol), np.arange(len(self.names) + 1))
        self.levels = max(1, int(len(self.names) - 1).bit_length())
        self.bits, self.before, self.zeros, self.start = [], [], [], np.zeros(len(self.names), np.int64)
        ids = np.arange(len(self.names))
        row = symbol[suffix - 1]
        for level in reversed(range(self.levels)):
            bit = (row >> level & 1).astype(bool)
            packed, before = self._packed(bit)
            self.bits.append(packed)
            self.before.append(before)
            self.zeros.append(int(len(bit) - bit.sum()))
            row = np.concatenate([row[~bit], row[bit]])
            one = self._ones(packed, before, self.start)
            self.start = np.where(ids >> level & 1, self.zeros[-1] + one, self.start - one)
        ends = np.flatnonzero(symbol == 0)
        owner = np.searchsorted(ends, suffix)
        long = ends[owner] - suffix >= width if self.n else np.zeros(0, bool)
        self.marks, self.owner = self._packed(long), owner[long].astype(np.uint32)

    @staticmethod
    def _suffixes(symbol: np.ndarray) -> np.ndarray:
        n, ends = len(symbol), symbol == 0
        rank = symbol.astype(np.int64) + int(ends.sum())
        rank[ends] = np.arange(int(ends.sum()))  # ends differ, so every suffix has its place
        step, order = 1, np.zeros(0, np.int64)
        while n:
            follow = np.zeros(n, np.int64)
            follow[:-step or None] = rank[step:] + 1
            order = np.argsort(key := rank * (int(rank.max(initial=0)) + int(n) + 2) + follow, kind="stable")
            new = np.zeros(n, np.int64)
            new[order] = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]])
            rank, step = new, step * 2
            if rank.max() == n - 1 or step > n:
                break
        return order

    @staticmethod
    def _packed(bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, bool)), bitorder="little").view(np.uint64)
        return packed, np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)).astype(np.uint32)

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (U64(1) << (at & 63).astype(np.uint64)) - U64(1)
        return before[word].astype(np.int64) + np.bitwise_count(packed[word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        position = at
        for i, level in enumerate(reversed(range(self.levels))):
            one = self._ones(self.bits[i], self.before[i], position)
            position = np.where(symbol >> level & 1, self.zeros[i] + one, position - one)
        return position - self.start[symbol]

    def search(self, patterns: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, length) for rows of symbols, backward from the last: length is that of the longest end of the row that at
        least `least` suffixes start with, and low to high is their interval. For rows that lie in the index themselves, least = 2
        gives their matching statistics against the rest of it."""
        ids = np.searchsorted(self.names, patterns)
        ids[ids == len(self.names)] = 0
        known = (self.names[ids] == patterns) & (ids > 0)
        rows, width = patterns.shape
        low, high, length = np.zeros(rows, np.int64), np.full(rows, self.n, np.int64), np.zeros(rows, np.int64)
        live = np.arange(rows)
        for j in reversed(range(width)):
            live = live[known[live, j]]
            c = ids[live, j]
            if j == width - 1:
                a, b = self.first[c], self.first[c + 1]
            else:
                both = self.rank(np.concatenate([c, c]), np.concatenate([low[live], high[live]]))
                a, b = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
            good = b - a >= least
            live = live[good]
            low[live], high[live], length[live] = a[good], b[good], length[live] + 1
        return low, high, length

    def least(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The smallest value (one a sequence) among the suffixes of each interval; the intervals are not empty, are of patterns of at least
        `width` symbols, and are equal or apart."""
        begin, which, back = np.unique(low, return_index=True, return_inverse=True)
        if not len(begin):
            return np.zeros(0, value.dtype)
        places = self._ones(*self.marks, np.stack([begin, high[which]], 1).ravel())
        return np.minimum.reduceat(np.append(value[self.owner], np.iinfo(value.dtype).max), places)[::2][back]


def _hashes(w: Words) -> np.ndarray:
    return w.hashes() | U64(1)  # 0 ends a sequence


def anchors(h: np.ndarray, first: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, anchor) of each segment; h: words' hashes, first: of each document."""
    places = width - ANCHOR + 1
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    run = np.zeros(len(h) - ANCHOR + 1, U64)
    for j in range(ANCHOR):
        run += h[j : j + len(run)] * _POWER[j]
    run = mix(run)
    best, where = run[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, places):
        better = run[j : j + n] < best
        best[better], where[better] = run[j : j + n][better], j
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(doc[:n] == doc[width - 1 :])
    spot = start + where[start]
    new = np.ones(len(start), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(new)
    return start[begin], np.diff(np.append(begin, len(start))), best[start[begin]]


@trimmed
def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, whole_sha256 (of the words joined by one space)."""
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            w = words(data, offsets)
            shas = []
            for i in range(hi - lo):
                a, b = w.first[i], w.first[i + 1]
                own = w.data[w.start[a] : w.end[b - 1]].tobytes() if b > a else b""
                shas.append(hashlib.sha256(b" ".join(own.translate(_BLANK).split())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(w.counts(), pa.int64()), pa.array(shas)], names=["doc_id", "n_words", "whole_sha256"])


_BLANK = bytes(32 if 9 <= b <= 13 else b for b in range(256))
#: An entry of an anchor: its document, the segment's first word and number of windows; or, with 0 windows, the number of segments
#: of the batch, in several of whose documents the anchor is.
_ENTRY = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "u1")])


def _entries(batch: pa.RecordBatch, width: int) -> np.ndarray:
    parts = []
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for lo, hi, data, offsets in blocks(batch.column(1)):
        w = words(data, offsets)
        start, n, anchor = anchors(_hashes(w), w.first, width)
        doc = np.searchsorted(w.first, start, "right") - 1
        e = np.zeros(len(start), _ENTRY)
        e["anchor"], e["doc"], e["start"], e["n"] = anchor, ids[lo:hi][doc], start - w.first[doc], n
        parts.append(e)
    e = np.concatenate(parts) if parts else np.zeros(0, _ENTRY)
    parts.clear()
    return e[np.lexsort((e["doc"], e["anchor"]))]


def _shared(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether the entry's anchor is shared, whether the entry is its anchor's first); e is sorted."""
    if not len(e):
        return np.zeros(0, bool), np.zeros(0, bool)
    new = np.r_[True, e["anchor"][1:] != e["anchor"][:-1]]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(e)))
    last = begin + size - 1
    yes = (e["doc"][begin] != e["doc"][last]) | (np.minimum.reduceat(e["n"], begin) == 0)
    return np.repeat(yes, size), new


def _deal(width: int, parts: int):
    """Anchors by part; one entry for an anchor that several documents of the batch share."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = _entries(batch, width)
            shared, new = _shared(e)
            size = np.diff(np.append(np.flatnonzero(new), len(e)))
            some = ~shared | new
            size = size[np.cumsum(new)[some] - 1] if len(e) else size
            e = e[some]
            own = shared[some]
            e["start"][own] = size[own]
            e["n"][own] = 0
            del shared, new, size, some, own
            part = ((e["anchor"] >> U64(20)) % U64(parts)).astype(np.int32)
            e = e[order := np.argsort(part, kind="stable")]
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            del part, order
            own = np.flatnonzero(np.diff(ends))
            where = (np.append(ends[own], len(e)) * e.itemsize).astype(np.int32)  # parts without entries take no room
            entries = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(where), pa.py_buffer(e.view(np.uint8))])
            del e
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), entries], names=["part", "entries"])

    return run


def _segments(e: np.ndarray) -> dict[str, np.ndarray]:
    return {"doc_id": e["doc"].astype(np.int64), "segment": e["start"].astype(np.int64) << 8 | e["n"]}


def _local(width: int):
    """The segments of anchors that several documents of the batch share."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = _entries(batch, width)
            got = _segments(e[_shared(e)[0]])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got.values()], names=list(got))

    return run


def _meet(hot: int):
    """The segments of shared anchors; and, for each anchor of more than `hot` segments, the anchor as doc_id with the segment -1."""

    @trimmed
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        e = np.frombuffer(b"".join(frame["entries"]), _ENTRY)
        e = e[np.lexsort((e["doc"], e["anchor"]))]
        shared, new = _shared(e)
        found = _segments(e[shared & (e["n"] > 0)])
        begin = np.flatnonzero(new)
        many = e["anchor"][begin[np.add.reduceat(np.where(e["n"] > 0, 1, e["start"].astype(np.int64)), begin) > hot]] if len(e) else e["anchor"]
        return pd.DataFrame({"doc_id": np.append(found["doc_id"], many.view(np.int64)), "segment": np.append(found["segment"], np.full(len(many), -1))})

    return run


def _windows(h: np.ndarray, begin: np.ndarray, segment: np.ndarray, doc: np.ndarray, hot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, segment, shard hash) with the segments of hot anchors cut into windows. h: the words' hashes; begin: of each document in it."""
    at, n = begin[doc] + (segment >> 8), segment & 255
    anchor = np.full(len(at), np.iinfo(np.uint64).max, U64)
    for j in range(width - ANCHOR + 1):
        run = np.zeros(len(at), U64)
        for i in range(ANCHOR):
            run += h[at + j + i] * _POWER[i]
        anchor = np.minimum(anchor, mix(run))
    many = np.isin(anchor, hot) if len(hot) else np.zeros(len(at), bool)
    if not many.any():
        return doc, segment, anchor
    times = np.where(many, n, 1)
    own = np.repeat(np.arange(len(at)), times)
    step = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
    single = many[own]
    key = anchor[own]
    place, whole = at[own[single]] + step[single], np.zeros(int(single.sum()), U64)
    for j in range(width):
        whole = mix(whole + h[place + j])
    key[single] = whole
    return doc[own], np.where(single, ((segment[own] >> 8) + step) << 8 | 1, segment[own]), key


def _cut_out(batch: pa.RecordBatch, width: int, hot: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc_id, segment, words' hashes as rows padded by 0, 16-byte keys, shard hash) of a block of (doc_id, text, segments)."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for lo, hi, data, offsets in blocks(batch.column(1)):
        w = words(data, offsets)
        h = np.append(_hashes(w), np.zeros(width + 300, U64))
        lists = batch.column(2).slice(lo, hi - lo)
        segment = lists.flatten().to_numpy(zero_copy_only=False)
        doc, segment, shard = _windows(h, w.first, segment, np.repeat(np.arange(hi - lo), np.diff(lists.offsets.to_numpy())), hot, width)
        n = segment & 255
        place = np.arange(int(n.max(initial=0)) + width - 1)[None, :]
        rows = np.where(place < (n + width - 1)[:, None], h[(w.first[doc] + (segment >> 8))[:, None] + place], U64(0))
        yield ids[lo:hi][doc], segment, rows, _digest(rows), shard


def _digest(rows: np.ndarray) -> np.ndarray:
    """The keys of rows of words' hashes, padded by 0."""
    a, b = np.zeros(len(rows), U64), np.zeros(len(rows), U64)
    for j in range(rows.shape[1]):
        live = rows[:, j] != 0
        a[live], b[live] = mix(a[live] + rows[live, j]), mix(b[live] ^ rows[live, j] * _STEP)
    return np.stack([a, b], 1)


def _keys(keys: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys))]).cast(pa.binary())


def _distinct(width: int, shards: int, hot: np.ndarray):
    """Distinct segments: shard, first (smallest doc_id), several (whether more than one document of the batch has it), words."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, segment, rows, keys, shard in _cut_out(batch, width, hot):
                if not len(doc):
                    continue
                order = np.lexsort((doc, keys[:, 1], keys[:, 0]))
                new = np.r_[True, (keys[order][1:] != keys[order][:-1]).any(axis=1)]
                begin = np.flatnonzero(new)
                own = order[begin]
                several = doc[own] != doc[order[np.append(begin[1:], len(order)) - 1]]
                length = (segment[own] & 255) + width - 1
                text = [x[:m].tobytes() for x, m in zip(rows[own], length, strict=True)]
                part = (mix(shard[own]) >> U64(24)) % U64(shards)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(doc[own], pa.int64()), pa.array(several), pa.array(text, pa.binary())], names=["shard", "first", "several", "words"])

    return run


def _index(width: int):
    """A shard's segments against its index: key, firsts (the smallest doc_id that holds each window, int64; one value if they are all
    the same). Segments that one document alone has, and whose windows no earlier one has, are left out."""

    @trimmed
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        one = frame.groupby("words", sort=True).agg(first=("first", "min"), last=("first", "max"), several=("several", "any"))
        first = one["first"].to_numpy(np.int64)
        several = one["several"].to_numpy(bool) | (first != one["last"].to_numpy(np.int64))
        length = np.array([len(x) // 8 for x in one.index])
        flat = np.frombuffer(b"".join(x + bytes(8) for x in one.index), U64)
        index = FMIndex(flat, width)
        begin = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
        count = length - width + 1
        owner = np.repeat(np.arange(len(one)), count)
        at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        place = np.arange(width)[None, :]
        least = first[owner]
        for a in range(0, len(at), 1 << 18):
            low, high, matched = index.search(flat[at[a : a + (1 << 18), None] + place], least=2)
            above = np.flatnonzero(matched >= width)
            least[a + above] = index.least(low[above], high[above], first)
        early = np.logical_or.reduceat(least < first[owner], np.cumsum(count) - count)
        some = np.flatnonzero(early | several)
        rows = np.zeros((len(some), int(length[some].max(initial=0))), U64)
        inside = np.arange(rows.shape[1])[None, :] < length[some, None]
        rows[inside] = flat[(begin[some, None] + np.arange(rows.shape[1])[None, :])[inside]]
        parts = np.split(least, np.cumsum(count)[:-1])
        return pd.DataFrame({"key": [x.tobytes() for x in _digest(rows)], "firsts": [parts[i].tobytes() if early[i] else first[i].tobytes() for i in some]})

    return run


def _uses(width: int, hot: np.ndarray):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, segment, _, keys, _ in _cut_out(batch, width, hot):
                yield pa.RecordBatch.from_arrays([_keys(keys), pa.array(doc, pa.int64()), pa.array(segment, pa.int64())], names=["key", "doc_id", "segment"])

    return run


def _ranges(width: int):
    """Runs of words to remove: doc_id, run (first word << 32 | number of words)."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, segment = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            n = segment & 255
            values = batch.column(2).to_pylist()
            size = np.array([len(x) // 8 for x in values])
            firsts = np.repeat(np.frombuffer(b"".join(values), np.int64), np.repeat(np.where(size < n, n, 1), size))
            owner = np.repeat(np.arange(len(n)), n)
            window = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            early = firsts < doc[owner]
            owner, window = owner[early], window[early]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1)
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(owner)))
            who = owner[begin]
            word = (segment[who] >> 8) + window[begin]
            yield pa.RecordBatch.from_arrays([pa.array(doc[who], pa.int64()), pa.array(word << 32 | (size + width - 1), pa.int64())], names=["doc_id", "run"])

    return run


@trimmed
def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, runs) as doc_id, removed (number of words), kept (the other words joined by one space)."""
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            w = words(data, offsets)
            lists = batch.column(2).slice(lo, hi - lo)
            runs = lists.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(hi - lo), np.diff(lists.offsets.to_numpy()))
            begin = w.first[doc] + (runs >> 32)
            step = np.bincount(begin, minlength=len(w.start) + 1) - np.bincount(begin + (runs & 0xFFFFFFFF), minlength=len(w.start) + 1)
            gone = np.cumsum(step)[:-1] > 0
            left, removed = [], []
            for i in range(hi - lo):
                a, b = w.first[i], w.first[i + 1]
                own = gone[a:b]
                removed.append(int(own.sum()))
                left.append(" ".join([w.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(w.start[a:b][~own], w.end[a:b][~own], strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(removed, pa.int64()), pa.array(left)], names=["doc_id", "removed", "kept"])


@tidy
@scratch
def repeated(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(facts, removals) for docs (doc_id, text; others are ignored).

    facts: doc_id, n_words, whole_sha256, copy (its words are those of a document with a smaller doc_id, and there are
    `width` or more). removals: doc_id, removed, kept, for documents that lose words and are no copies. Null and empty texts
    have no words. Rows with a null doc_id have no order: they take no part and keep their words. Of rows that repeat a doc_id
    each is judged by itself against smaller doc_ids.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    enough = lambda n_bytes: max(LOTS * parts, -(-int(n_bytes) // PART_BYTES))
    rows = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    named = rows.where("doc_id is not null")
    facts = cut(rows.mapInArrow(_facts, "doc_id long, n_words long, whole_sha256 string"))
    groups = facts.where(F.col("n_words") >= width).groupBy("whole_sha256").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("whole_sha256", "low")
    groups = cut(groups)  # as a table, so that the join can split a large group
    copies = cut(facts.join(groups, "whole_sha256").where(F.col("doc_id") > F.col("low")).select("doc_id", F.col("whole_sha256").alias("_sha")).distinct())
    n_words = facts.agg(F.sum("n_words")).first()[0] or 0
    dealt = named.mapInArrow(_deal(width, enough(n_words * _ENTRY.itemsize / 4)), "part int, entries binary")
    met = cut(dealt.groupBy("part").applyInPandas(_meet(max(HOT, n_words // HOT_ANCHORS)), "doc_id long, segment long"))
    hot = np.sort(np.array([x.doc_id for x in met.where("segment < 0").select("doc_id").collect()], np.int64).view(U64))  # HOT_ANCHORS at most
    met = met.where("segment >= 0").union(named.mapInArrow(_local(width), "doc_id long, segment long"))
    once = facts.groupBy("doc_id").count().where("count > 1").select("doc_id")  # repeated ids keep even their copies
    lists = met.groupBy("doc_id").agg(F.array_sort(F.collect_set("segment")).alias("segments")).join(copies.join(once, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_anti")
    held = cut(named.join(lists, "doc_id").select("doc_id", "text", "segments"))
    n_segments = held.agg(F.sum(F.size("segments"))).first()[0] or 0
    shards = enough(n_segments * 8 * (width + ANCHOR))
    found = cut(held.mapInArrow(_distinct(width, shards, hot), "shard int, first long, several boolean, words binary").groupBy("shard").applyInPandas(_index(width), "key binary, firsts binary"))
    uses = held.mapInArrow(_uses(width, hot), "key binary, doc_id long, segment long")
    runs = cut(uses.join(found.hint("merge"), "key").select("doc_id", "segment", "firsts").mapInArrow(_ranges(width), "doc_id long, run long").groupBy("doc_id").agg(F.collect_list("run").alias("runs")))
    removals = cut(held.select("doc_id", "text").join(runs, "doc_id").select("doc_id", "text", "runs").mapInArrow(_remove, "doc_id long, removed long, kept string"))
    copy = facts.join(copies, (facts["doc_id"] == copies["doc_id"]) & (facts["whole_sha256"] == copies["_sha"]), "left").select(facts["doc_id"], "n_words", "whole_sha256", F.col("_sha").isNotNull().alias("copy"))
    return copy, removals


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    facts, removals = repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = removals.select("doc_id", "removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("sha"))
    none = F.sha2(F.encode(F.lit(""), "UTF-8"), 256)
    return facts.join(gone, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), none).otherwise(F.coalesce("sha", "whole_sha256")).alias("kept_sha256"),
    )
