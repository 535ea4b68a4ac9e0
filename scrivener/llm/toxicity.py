"""Toxicity by multiple-instance learning.

A document is a bag of sentences and a sentence a set of hashed words. A sentence's score is a logistic
function of its words' weights; a document's is the noisy-or of its sentences: one minus the chance that
none is toxic. Only document labels are needed to train. Weights are not negative, so that nothing else
in a sentence makes up for an offending word, and an L1 penalty keeps only words that tell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import _LOWER, blocks, trim, trimmed, words

FEATURE_BITS = 18
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000  #: at most so many labelled documents of each kind are learnt from
SAMPLE_BYTES = 1 << 28  #: and, of those in the order of a hash of their texts, at most about so many bytes
THRESHOLD = 0.7
STEPS, RATE, L2 = 250, 0.15, 1e-7
CHUNK = 1 << 19  #: words of a fit that are summed at a time
L1 = 0.25  #: in labelled documents; choose_penalty() on the training rows of sf0.1 finds it best of PENALTIES
PENALTIES, FOLDS = (0.125, 0.25, 0.5, 1.0, 2.0, 4.0), 3
LEAST_TOXIC_DOCS = 3  #: a word met in fewer toxic documents gets no weight

_PART = np.zeros(256, bool)  # what separates words: ASCII but letters and digits
_PART[:128] = True
_PART[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_STOP = np.zeros(256, bool)  # what ends a sentence
_STOP[[*b".!?\n\r"]] = True


class Sentences:
    """The sentences of a block of documents: feature ids, each word's sentence, each sentence's document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = words(np.where(_PART[data] & ~_STOP[data], np.uint8(32), _LOWER[data]), offsets, separators=_PART)
        stops = np.cumsum(_STOP[w.data])
        n = np.diff(w.first)
        self.word_doc = np.repeat(np.arange(len(n)), n)
        after = stops[w.start] if len(w.start) else np.zeros(0, np.int64)
        new = np.ones(len(after), bool)
        new[1:] = (after[1:] != after[:-1]) | (self.word_doc[1:] != self.word_doc[:-1])
        self.sentence = np.cumsum(new) - 1
        self.doc = self.word_doc[new]
        self.features = (w.hashes() >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
        last = np.ones(len(after), bool)
        last[:-1] = new[1:]
        self.start, self.end = w.start[new], w.end[last]  # in w.data
        self.span, self.docs = w.span, len(n)

    def scores(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
        """(of each sentence, of each document); a word counts once in a sentence."""
        key = np.unique(self.sentence << FEATURE_BITS | self.features) if len(self.features) else np.zeros(0, np.int64)
        z = bias + np.bincount(key >> FEATURE_BITS, weights[key & ((1 << FEATURE_BITS) - 1)], len(self.doc))
        none = np.bincount(self.doc, np.logaddexp(0, z), self.docs)
        return 1 / (1 + np.exp(-z)), -np.expm1(-none)


def fit(sentence: np.ndarray, feature: np.ndarray, doc: np.ndarray, label: np.ndarray, l1: float = L1) -> tuple[np.ndarray, float]:
    """Weights and bias that make the labels likely. sentence, feature: a row for each word of a sentence, sentences ascending; doc: of
    each sentence; label: of each document."""
    size, y = 1 << FEATURE_BITS, label.astype(float)
    cuts = np.unique(np.append(np.searchsorted(sentence, sentence[::CHUNK]), len(sentence)))
    spans = [slice(*x) for x in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]  # whole sentences each
    toxic_docs = [np.zeros(0, np.int64)]
    for span in spans:
        d, f = doc[sentence[span]], feature[span]
        toxic_docs.append(np.unique(d[y[d] > 0].astype(np.int64) << FEATURE_BITS | f[y[d] > 0]))
    allowed = np.bincount(np.unique(np.concatenate(toxic_docs)) & (size - 1), minlength=size) >= LEAST_TOXIC_DOCS
    names, column = np.flatnonzero(allowed), (np.cumsum(allowed) - 1).astype(np.int32)
    chunks = [(sentence[span][keep], column[feature[span][keep]]) for span in spans if (keep := allowed[feature[span]]).any()]
    del toxic_docs, allowed
    w, bias = np.zeros(len(names)), -4.0
    moments, every = np.zeros((2, len(names) + 1)), np.arange(len(names))
    for step in range(1, STEPS + 1):
        z = np.full(len(doc), bias)
        for r, c in chunks:
            z[r[0] : r[-1] + 1] += np.bincount(r - r[0], w[c])
        none = np.bincount(doc, np.logaddexp(0, z), len(y))
        p = np.maximum(-np.expm1(-none), 1e-12)
        slope = (1 / (1 + np.exp(-z))) * (1 - y / p)[doc] / max(1, len(y))
        total = np.zeros(len(names))
        for r, c in chunks:  # onto the total, so that the sums are those of one pass
            total = np.bincount(np.append(every, c), np.append(total, slope[r]))
        grad = np.append(total + l1 / max(1, len(y)) + L2 * w, slope.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, bias = np.maximum(0, w - move[:-1]), float(np.clip(bias - move[-1], -30, 5))
    weights = np.zeros(size, np.float32)
    weights[names] = w
    return weights, bias


def _bags(batches: Iterator[pa.RecordBatch], folds: list | None = None) -> list[np.ndarray]:
    """The arguments of fit() for batches of text and label, from about SAMPLE_BYTES of text at most; empty without rows. folds gets their third column."""
    sentence, feature, doc, label, sentences, docs, n_bytes = [], [], [], [], 0, 0, 0
    for batch in batches:
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in blocks(batch.column(0)):
            if n_bytes and n_bytes + len(data) > SAMPLE_BYTES:
                continue
            n_bytes += len(data)
            s = Sentences(data, offsets)
            key = np.unique(s.sentence << FEATURE_BITS | s.features) if len(s.features) else np.zeros(0, np.int64)
            sentence.append(((key >> FEATURE_BITS) + sentences).astype(np.int32))
            feature.append((key & ((1 << FEATURE_BITS) - 1)).astype(np.int32))
            doc.append((s.doc + docs).astype(np.int32))
            label.append(y[lo:hi])
            if folds is not None:
                folds.append(batch.column(2).to_numpy()[lo:hi])
            sentences, docs = sentences + len(s.doc), docs + hi - lo
    bags = []
    for x in (sentence, feature, doc, label) if docs else ():
        bags.append(np.concatenate(x))
        x.clear()
    trim()
    return bags


@trimmed
def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if bags := _bags(batches):
        weights, bias = fit(*bags)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])


def _part_of(bags: list[np.ndarray], docs: np.ndarray) -> list[np.ndarray]:
    """The bags of the documents marked in docs, numbered anew."""
    sentence, feature, doc, label = bags
    some = docs[doc]
    words_ = some[sentence]
    return [(np.cumsum(some) - 1)[sentence[words_]], feature[words_], (np.cumsum(docs) - 1)[doc[some]], label[docs]]


def _compare(penalties: tuple[float, ...]):
    """The mean log loss of each penalty over folds; equal texts share a fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds: list[np.ndarray] = []
        if bags := _bags(batches, folds):
            fold = np.concatenate(folds)
            for l1 in penalties:
                total = 0.0
                for k in range(FOLDS):
                    weights, bias = fit(*_part_of(bags, fold != k), l1=l1)
                    sentence, feature, doc, label = _part_of(bags, fold == k)
                    z = bias + np.bincount(sentence, weights[feature], len(doc))
                    none = np.maximum(np.bincount(doc, np.logaddexp(0, z), len(label)), 1e-12)
                    total += float(np.where(label > 0, -np.log(-np.expm1(-none)), none).sum())
                yield pa.RecordBatch.from_arrays([pa.array([l1]), pa.array([total / len(fold)])], names=["l1", "loss"])

    return run


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> DataFrame:
    """text, toxic of labelled rows that are not held out, in one part.

    Of either kind those with the smallest hashes of doc_id enter, `toxic` and `clean` at most; the bound keeps the
    one task that fits small, at any size of the corpus. Null labels and ids, labels other than 0 and 1, ids whose
    labels disagree and labels without a document are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select("doc_id", "toxic")
    first = F.xxhash64("doc_id", F.lit("toxicity"))
    some = known.where("toxic = 1").orderBy(first).limit(toxic).union(known.where("toxic = 0").orderBy(first).limit(clean))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = rows.join(F.broadcast(some), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))  # at most toxic + clean rows
    return sample.repartition(1).sortWithinPartitions(F.xxhash64("text"), "text")


def train(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> tuple[np.ndarray, float]:
    """(weights, bias) learnt from the rows of _sample(). With no label nothing has a weight."""
    model = _sample(docs, labels, toxic, clean).mapInArrow(_learn, "weights binary, bias double").first()
    if model is None:
        return np.zeros(1 << FEATURE_BITS, np.float32), -20.0
    return np.frombuffer(model["weights"], np.float32), model["bias"]


def choose_penalty(docs: DataFrame, labels: DataFrame, penalties: tuple[float, ...] = PENALTIES, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """l1, loss: each penalty's mean log loss over folds of the rows that train() may learn from; held-out rows have no
    part in it. Without labels no rows."""
    rows = _sample(docs, labels, toxic, clean).withColumn("fold", F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit("fold")), F.lit(FOLDS)).cast("int"))
    return rows.mapInArrow(_compare(penalties), "l1 double, loss double")


def _score(weights: bytes, bias: float, least: float):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights, np.float32)
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                s = Sentences(data, offsets)
                each, whole = s.scores(w, bias)
                hit = np.flatnonzero(each >= least)
                shift = s.doc[hit]  # a space follows each document in s.span
                found = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(s.start[hit] - shift, s.end[hit] - shift, strict=True)]
                ends = np.concatenate([[0], np.cumsum(np.bincount(s.doc[hit], minlength=hi - lo))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.clip(whole, 0, 1)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.string()))],
                    names=["doc_id", "score", "offending"],
                )

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 from `threshold`), offending (its sentences that
    alone reach the threshold).

    Only the text counts. Null and empty texts and texts without words have score 0. Rows are independent.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_score(model[0].tobytes(), float(model[1]), threshold), "doc_id long, score double, offending array<string>")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _clean(weights: bytes, bias: float, least: float, at: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights, np.float32)
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(at)):
                _, whole = Sentences(data, offsets).scores(w, bias)
                yield batch.slice(lo, hi - lo).filter(pa.array(np.clip(whole, 0, 1) < least))

    return run


def clean(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, that score() does not predict toxic; each row by its own text."""
    return docs.mapInArrow(_clean(model[0].tobytes(), float(model[1]), threshold, docs.columns.index("text")), docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    """The contract's columns, and `offending`: the sentences that alone reach the threshold, a line each (no sentence holds a line's end)."""
    return score(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted", F.array_join("offending", "\n").alias("offending"))
