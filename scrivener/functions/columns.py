"""Column expressions and the join that every operator shares: one definition each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR_DB, SILENCE_DENSITY = -120.0, 0.15


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def touches(start: Column, end: Column, a: Column, b: Column) -> Column:
    """A cue touches [a, b] if they share time; a cue without length if it starts inside, ends included."""
    return F.when(end <= start, (a <= start) & (start <= b)).otherwise((F.least(end, b) - F.greatest(start, a)) > 0)


def reference_text(track: str = "zh") -> Column:
    zh = F.coalesce("zh", F.lit(""))
    return zh if track == "zh" else F.coalesce(F.nullif(F.col("native"), F.lit("")), zh)


def ratio(a: Column, b: Column) -> Column:
    """NULL where there is nothing to divide by."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def seconds(stamp: Column) -> Column:
    """`1:02:03`, `93:27` or `7`: base 60, any number of parts, empty parts skipped."""
    parts = F.filter(F.split(stamp, ":"), lambda x: x != "")
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x.cast("double"))


def clock(sec: Column) -> Column:
    """h:mm:ss of rounded seconds."""
    s = F.rint(sec).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def clamped_db(token: Column) -> Column:
    """A level in dB; what is no finite number, or lower than the floor, is the floor."""
    v = token.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), FLOOR_DB).otherwise(F.greatest(v, F.lit(FLOOR_DB)))


def mean_db(db: Column) -> Column:
    """An aggregate: the level of the mean power."""
    power = F.avg(F.pow(F.lit(10.0), db / 10))
    return F.coalesce(F.when(power > 0, 10 * F.log10(power)), F.lit(FLOOR_DB))


def verdict(density: Column) -> Column:
    return F.when(density.isNull(), "undecidable").when(density < SILENCE_DENSITY, "true_hallucination").otherwise("untranscribed_speech")


def ordered_text(order: list[str], text: str) -> Column:
    """An aggregate: texts joined in the order given; the order must be total."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return F.array_join(F.transform(rows, lambda x: x["_t"]), "")


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that is never broadcast: Spark estimates what is exploded, or cut to a few columns, far too low, and both grow with the input."""
    return left.join(right.hint("merge"), on, how)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
