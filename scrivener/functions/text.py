"""Normal forms, alignment and term search of transcript text, as plain functions and as Arrow UDFs."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
MYRIAD = "萬"
FILLERS = "呃嗯欸唔哦"
DIALECT_MARKERS = (
    "迄", "佇", "毋", "袂", "恁", "阮", "囡", "攏", "捌", "佮", "拄", "蹛", "媠", "濟",
    "逐家", "按怎", "這馬", "啥物", "歹勢", "彼个", "頭家", "無彩", "拍拚", "猶原", "敢若",
)

_DIGIT, _UNIT = "".join(DIGITS), "".join(UNITS)
_NUMERAL = re.compile(f"[{_DIGIT}{_UNIT}{MYRIAD}]+")
_GROUP = re.compile(f"([{_DIGIT}]*)([{_UNIT}])")


class _Kept(dict):
    """A translate() table, filled as characters are met: punctuation, separators, control and space go."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = None if unicodedata.category(c)[0] in "PZC" or c.isspace() else code
        return self[code]


_KEPT = _Kept()
_NO_FILLERS = str.maketrans("", "", FILLERS)


def _below_myriad(part: str) -> int:
    """The digit next to a unit counts it (none or zero: once); a digit after the last unit is added."""
    value, at = 0, 0
    for m in _GROUP.finditer(part):
        count = DIGITS[m[1][-1]] if m[1] else 0
        value += max(1, count) * UNITS[m[2]]
        at = m.end()
    return value + (DIGITS[part[-1]] if part[at:] else 0)


def numeral(run: str) -> str:
    """A run of Chinese numerals in Arabic ones: digit by digit if it has no unit."""
    if not any(c in UNITS or c == MYRIAD for c in run):
        return "".join(str(DIGITS[c]) for c in run)
    *high, low = run.split(MYRIAD)
    return str(sum(_below_myriad(x) for x in high) * 10000 + _below_myriad(low))


def normal(text: str | None, drop_fillers: bool = False) -> str:
    """NFKC, numerals, upper case, no punctuation or space, then fillers if asked; in this order."""
    if not text:
        return ""
    out = _NUMERAL.sub(lambda m: numeral(m[0]), unicodedata.normalize("NFKC", text)).upper().translate(_KEPT)
    return out.translate(_NO_FILLERS) if drop_fillers else out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _next_row(row: np.ndarray, symbol: int, hyp: np.ndarray, index: np.ndarray) -> np.ndarray:
    v = np.empty_like(row)
    v[0] = row[0] + 1
    np.minimum(row[1:] + 1, row[:-1] + (hyp != symbol), out=v[1:])
    return np.minimum.accumulate(v - index) + index


def substring_distance(ref: str, hyp: str) -> int:
    """The fewest edits between ref and any substring of hyp."""
    if not ref or not hyp:
        return len(ref)
    h = _codes(hyp)
    row, index = np.zeros(len(h) + 1, np.int32), np.arange(len(h) + 1, dtype=np.int32)
    for symbol in _codes(ref):
        row = _next_row(row, symbol, h, index)
    return int(row.min())


def substring_costs(ref: str, hyp: str) -> tuple[int, list[int]]:
    """(distance, edits charged to each character of ref) of one best alignment: the leftmost end, and from there back an
    insertion where one fits, else a match or substitution, else a deletion.

    Only every sqrt(n)-th row is kept; the rows between are made again on the way back.
    """
    n, m = len(ref), len(hyp)
    if n == 0 or m == 0:
        return n, [1] * n
    r, h = _codes(ref), _codes(hyp)
    index, gap = np.arange(m + 1, dtype=np.int32), math.isqrt(n) + 1
    row = np.zeros(m + 1, np.int32)
    kept = {0: row}
    for i in range(1, n + 1):
        row = _next_row(row, r[i - 1], h, index)
        if i % gap == 0:
            kept[i] = row
    at = int(row.argmin())
    distance, costs, i, low, block = int(row[at]), [0] * n, n, n + 1, []
    while i > 0:
        if i - 1 < low:
            low = (i - 1) // gap * gap
            block = [kept[low]]
            for k in range(low + 1, i + 1):
                block.append(_next_row(block[-1], r[k - 1], h, index))
        here, up = block[i - low], block[i - 1 - low]
        if at and here[at] == here[at - 1] + 1:
            costs[i - 1] += 1
            at -= 1
            continue
        differs = int(at > 0 and r[i - 1] != h[at - 1])
        if at and here[at] == up[at - 1] + differs:
            costs[i - 1] += differs
            at -= 1
        else:
            costs[i - 1] += 1
        i -= 1
    return distance, costs


#: Cells of the rows of one batch of pairs that are held at a time; longer pairs go one by one.
BATCH_CELLS = 1 << 20


def _batches(pairs: list[tuple[str, str]], whole: bool) -> list[list[int]]:
    """Positions of pairs of like lengths, so many that their rows (whole: all rows, else the last) hold BATCH_CELLS at most."""
    size = [(len(r), len(h)) for r, h in pairs]
    out, rows, wide = [], 0, 0
    for k in sorted(range(len(pairs)), key=lambda k: (size[k][0].bit_length(), size[k][1])):
        n, m = size[k]
        old = size[out[-1][-1]] if out else (0, 0)
        high = max(rows, n)
        fits = out and old[0].bit_length() == n.bit_length() and m <= 1.5 * wide + 8 and (len(out[-1]) + 1) * (m + 1) * (high + 1 if whole else 1) <= BATCH_CELLS
        if fits:
            out[-1].append(k)
            rows = high
        else:
            out.append([k])
            rows, wide = n, m
    return out


def _padded(texts: list[str]) -> np.ndarray:
    m = max(map(len, texts))
    return _codes("".join(x.ljust(m, "\0") for x in texts)).reshape(len(texts), m)


def _next_rows(rows: np.ndarray, symbols: np.ndarray, hyps: np.ndarray, index: np.ndarray, out: np.ndarray) -> None:
    """_next_row() of many pairs at once. What stands behind a shorter text does not reach the columns before it."""
    out[:, 0] = rows[:, 0] + 1
    np.minimum(rows[:, 1:] + 1, rows[:, :-1] + (hyps != symbols[:, None]), out=out[:, 1:])
    out -= index
    np.minimum.accumulate(out, axis=1, out=out)
    out += index


def _distinct(refs: Iterable[str | None], hyps: Iterable[str | None]) -> tuple[list[tuple[str, str]], list[int]]:
    """(distinct pairs, the place of each pair among them)"""
    seen: dict[tuple[str, str], int] = {}
    place = [seen.setdefault((r or "", h or ""), len(seen)) for r, h in zip(refs, hyps, strict=True)]
    return list(seen), place


def substring_distances(refs: Iterable[str | None], hyps: Iterable[str | None]) -> list[int]:
    """substring_distance() of many pairs."""
    pairs, place = _distinct(refs, hyps)
    out = [len(r) for r, _ in pairs]
    todo = [k for k, (r, h) in enumerate(pairs) if r and h]
    for batch in _batches([pairs[k] for k in todo], False):
        own = [todo[k] for k in batch]
        if len(own) < 4:
            for k in own:
                out[k] = substring_distance(*pairs[k])
            continue
        own.sort(key=lambda k: -len(pairs[k][0]))
        r, h = _padded([pairs[k][0] for k in own]), _padded([pairs[k][1] for k in own])
        n, m = np.array([len(pairs[k][0]) for k in own]), np.array([len(pairs[k][1]) for k in own])
        index = np.arange(h.shape[1] + 1, dtype=np.int32)
        rows, other, left = np.zeros((len(own), len(index)), np.int32), np.empty((len(own), len(index)), np.int32), len(own)
        for i in range(r.shape[1]):
            _next_rows(rows[:left], r[:left, i], h[:left], index, other[:left])
            rows, other = other, rows
            rest = int(np.searchsorted(-n[:left], -(i + 1)))  # the first whose reference ends here
            if rest < left:
                best = np.where(index <= m[rest:left, None], rows[rest:left], np.iinfo(np.int32).max).min(axis=1)
                for k, d in zip(own[rest:left], best.tolist(), strict=True):
                    out[k] = d
                left = rest
    return [out[k] for k in place]


def substring_costs_many(refs: Iterable[str | None], hyps: Iterable[str | None]) -> list[np.ndarray]:
    """The edits of substring_costs() of many pairs, charged in the same way."""
    pairs, place = _distinct(refs, hyps)
    out = [np.ones(len(r), np.int32) for r, _ in pairs]
    todo = [k for k, (r, h) in enumerate(pairs) if r and h]
    for batch in _batches([pairs[k] for k in todo], True):
        own = [todo[k] for k in batch]
        if len(own) < 4:
            for k in own:
                out[k] = np.array(substring_costs(*pairs[k])[1], np.int32)
            continue
        r, h = _padded([pairs[k][0] for k in own]), _padded([pairs[k][1] for k in own])
        n, m, each = np.array([len(pairs[k][0]) for k in own]), np.array([len(pairs[k][1]) for k in own]), np.arange(len(own))
        index = np.arange(h.shape[1] + 1, dtype=np.int32)
        rows = np.zeros((r.shape[1] + 1, len(own), len(index)), np.int32)
        for i in range(r.shape[1]):
            _next_rows(rows[i], r[:, i], h, index, rows[i + 1])
        at = np.where(index <= m[:, None], rows[n, each], np.iinfo(np.int32).max).argmin(axis=1)
        costs, i = np.zeros(r.shape, np.int32), n.copy()
        while len(each):
            here, before = rows[i, each, at], np.maximum(at - 1, 0)
            inserted = (at > 0) & (here == rows[i, each, before] + 1)
            differs = (r[each, i - 1] != h[each, before]).astype(np.int32)
            across = ~inserted & (at > 0) & (here == rows[i - 1, each, before] + differs)
            costs[each, i - 1] += np.where(across, differs, 1)
            at = np.where(inserted | across, before, at)
            i = np.where(inserted, i, i - 1)
            going = i > 0
            if not going.all():
                each, at, i = each[going], at[going], i[going]
        for k, c, x in zip(own, costs, n.tolist(), strict=True):
            out[k] = c[:x].copy()
    return [out[k] for k in place]


def error_rate(ref: str, hyp: str) -> float:
    return substring_distance(ref, hyp) / len(ref) if ref else float(bool(hyp))


def find_terms(text: str, terms: Iterable[str]) -> dict[str, int]:
    """How often each term stands in text: longer terms first, then by code point; what a term has taken is gone for the rest."""
    found = {}
    for term in sorted({x for x in terms if x}, key=lambda x: (-len(x), x)):
        if n := text.count(term):
            found[term] = n
            text = text.replace(term, "\0" * len(term))  # no normal form holds U+0000
    return found


@F.pandas_udf(T.StringType())
def normal_udf(text: pd.Series, drop: pd.Series) -> pd.Series:
    asked = list(zip(text, drop, strict=True))
    seen = {x: normal(x[0], bool(x[1])) for x in set(asked)}
    return pd.Series([seen[x] for x in asked], dtype=object)


@F.pandas_udf(T.IntegerType())
def substring_distance_udf(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series(substring_distances(ref, hyp), dtype="int32")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def substring_costs_udf(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series(substring_costs_many(ref, hyp), dtype=object)


@F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def find_terms_udf(text: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([find_terms(t or "", [] if v is None else v) for t, v in zip(text, terms, strict=True)], dtype=object)


@F.pandas_udf(T.DoubleType())
def rounded_udf(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v else round(float(v), int(d)) for v, d in zip(x, digits, strict=True)], dtype="float64")


def normalized(text: Column | str, drop_fillers: bool = False) -> Column:
    return normal_udf(F.col(text) if isinstance(text, str) else text, F.lit(drop_fillers))


def rounded(x: Column, digits: int) -> Column:
    """Rounded as binary doubles round to nearest, which Spark's round() and bround() do not."""
    return rounded_udf(x, F.lit(digits))


def error_rate_of(ref: Column, hyp: Column, distance: Column | None = None) -> Column:
    distance = substring_distance_udf(ref, hyp) if distance is None else distance
    return F.when(F.length(ref) > 0, distance / F.length(ref)).otherwise(F.when(F.length(hyp) > 0, 1.0).otherwise(0.0))


def marker_hits(text: Column, markers: Iterable[str] = DIALECT_MARKERS) -> Column:
    """Occurrences of all markers, each counted by itself and without overlap of its own."""
    hits = F.lit(0)
    for m in markers:
        hits = hits + (F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m)
    return hits.cast("long")
