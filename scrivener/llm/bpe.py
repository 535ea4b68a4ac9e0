"""Byte-level BPE: encoding by batched merge rounds in numpy, and decoding.

The pieces of a text (by the vocabulary's pattern) repeat, so each task keeps the ids of pieces it has
met until it ends. Pieces that are new in a block are encoded together: their symbols lie in one flat array; in each
round every piece finds its lowest-ranked pair by binary search over the sorted pair keys and merges all
its occurrences, from left to right.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import BLOCK_BYTES, blocks, trim, trimmed

KEPT_PIECES = 400_000  #: pieces a task keeps; beyond that it starts anew
NONE = np.int64(1) << 60
LONG = 200  #: longer pieces are not kept


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable in Latin-1, else the next
    from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, more = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], more = chr(more), more + 1
    return [letters[b] for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary file (tokenizers' JSON)."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        back = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *added.values()]) + 1
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in added.items():
            self.bytes[i] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pair = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pairs, self.rank, self.made = pair[order], order.astype(np.int64), made[order]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.split = regex.compile("|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
        self.special = {x.encode(): i.to_bytes(4, "little") for x, i in added.items()}
        self.known: dict[str | bytes, bytes] = dict(self.special)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol made) of each pair; rank NONE where it does not merge."""
        at = np.searchsorted(self.pairs, key := left * self.size + right)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == key, self.rank[at], NONE), self.made[at]

    def merge(self, pieces: list[bytes]) -> tuple[bytes, list[int]]:
        """The ids of all pieces, in order, as little-endian unsigned 32-bit integers, and where each piece ends."""
        length = np.array([len(x) for x in pieces], np.int64)
        symbol = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), length)
        rank, made = self.ranks(symbol, np.append(symbol[1:], 0))  # of each symbol with the next
        rank[np.append(piece[1:] != piece[:-1], True)] = NONE
        done: list[tuple[np.ndarray, np.ndarray]] = [(piece[:0], symbol[:0])]
        while len(symbol):
            start = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(symbol))))
            if (ended := lowest == NONE).any():
                done.append((piece[ended], symbol[ended]))
                keep = ~ended
                symbol, piece, rank, made, lowest = symbol[keep], piece[keep], rank[keep], made[keep], lowest[keep]
            hit = rank == lowest
            if (hit[1:] & hit[:-1]).any():  # equal symbols in a row: every second pair of a run
                order = np.cumsum(hit) - 1
                lead = np.zeros(len(hit), np.int64)
                begin = hit & ~np.r_[False, hit[:-1]]
                lead[begin] = order[begin]
                hit &= (order - np.maximum.accumulate(lead)) % 2 == 0
            where = np.flatnonzero(hit)
            symbol[where] = made[where]
            stay = np.ones(len(symbol), bool)
            stay[where + 1] = False
            place = np.cumsum(stay) - 1
            symbol, piece, rank, made = symbol[stay], piece[stay], rank[stay], made[stay]
            where = place[where]
            changed = np.union1d(where, where[where > 0] - 1)
            inner = changed[changed < len(symbol) - 1]
            inner = inner[piece[inner] == piece[inner + 1]]
            rank[changed] = NONE
            rank[inner], made[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        piece, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(piece, kind="stable")
        return symbol[order].astype("<u4").tobytes(), np.cumsum(np.bincount(piece, minlength=len(pieces))).tolist()

    def forget(self) -> None:
        """Let go of the pieces met so far; an idle worker would keep them for a minute."""
        self.known = dict(self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        parts: list[list] = []
        find = self.pattern.findall
        for text in texts:
            own: list = []
            at = 0
            for m in self.split.finditer(text) if self.split else ():
                own += find(text[at : m.start()])
                own.append(m[0].encode())  # as bytes: a special token, not a piece
                at = m.end()
            own += find(text[at:] if at else text)
            parts.append(own)
        if len(self.known) > KEPT_PIECES:
            self.forget()
        known = self.known
        names = list(set().union(*parts).difference(known))
        if names:
            ids, ends = self.merge([x.encode() for x in names])
            at = 0
            for name, end in zip(names, ends, strict=True):
                known[name] = ids[at : 4 * end]
                at = 4 * end
        out = [b"".join(map(known.__getitem__, own)) for own in parts]
        for name in names:
            if len(name) > LONG:
                del known[name]
        return out

    def decode(self, ids: bytes) -> str:
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    bpe = Bpe(path)
    trim()  # the parsed file is several times as large
    return bpe


def _coded(bpe: Bpe, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    every = np.arange(batch.num_rows)
    others = [x.take(every) for x in batch.columns[:-1]]  # copies: slices would keep the whole batch
    text = batch.column(batch.num_columns - 1)
    for lo, hi, _, _ in blocks(text, BLOCK_BYTES):
        texts = text.slice(lo, hi - lo).fill_null("").to_pylist()
        ids = bpe.encode(texts)
        decoded = [bpe.decode(x) for x in ids]
        rest = [x.slice(lo, hi - lo) for x in others]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[*batch.schema.names[:-1], "ids", "decoded"])


def _encode(path: str):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        try:
            for batch in batches:
                yield from _coded(bpe, batch)
                del batch  # before the next one is read
        finally:
            bpe.forget()

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (doc_id, text; others are ignored) as doc_id, ids (binary, little-endian unsigned 32-bit
    integers), decoded (the text that the ids decode to).

    Null and empty texts have no ids and decode to the empty text. A special token's string in a text is that
    token. Rows are independent: repeated ids and null ids are returned as they come.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _encode(path or default_vocabulary()), "doc_id long, ids binary, decoded string"
    )


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
