"""Validation of manifests and golden lines as raw JSON: every error of every row, none hides another.

Documents are read as VARIANT, so an absent field, a null and a value of the wrong type are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGS = ("zho", "nan", "mixed", "eng")
REQUIRED = ("id", "seg", "t_start", "t_end", "spk", "lang", "zh")
MANIFEST_KEYS = ("set_id", "source_audio", "source_md5", "duration_sec", "segments")
SLACK = 0.5


def _get(v: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(v), f"$.{path}", kind)


def _type(v: str, path: str) -> Column:
    """BIGINT, DOUBLE, DECIMAL(..), STRING, BOOLEAN, ARRAY<..>, OBJECT<..>, VOID for null, NULL where absent."""
    return F.schema_of_variant(F.try_variant_get(F.col(v), f"$.{path}", "variant"))


def _number(v: str, path: str) -> Column:
    x = _get(v, path, "double")
    return F.when(_type(v, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _string(v: str, path: str) -> Column:
    return F.when(_type(v, path) == "STRING", _get(v, path, "string"))


def _full(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")) != "", F.lit(False))


def _falsy(v: str, path: str) -> Column:
    kind, x = _type(v, path), _get(v, path, "string")
    return F.coalesce(kind.isNull() | (kind == "VOID") | ((kind == "STRING") & (x == "")) | (kind.rlike("^(BIGINT|DOUBLE|DECIMAL)") & (_get(v, path, "double") == 0)) | ((kind == "BOOLEAN") & (x == "false")) | (x == "[]") | (x == "{}"), F.lit(True))


def _errors(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(found).alias("error"))


def manifest_segments(manifests: DataFrame) -> DataFrame:
    """set_id, idx, v (VARIANT) of each manifest's segments."""
    m = manifests.select("set_id", F.try_parse_json("raw").alias("m"))
    items = F.when(_type("m", "segments").startswith("ARRAY"), _get("m", "segments", "array<variant>"))
    return m.select("set_id", F.posexplode(items).alias("idx", "v"))


def manifest_errors(manifests: DataFrame) -> DataFrame:
    """set_id, place (null or the segment's index), error, for manifests (set_id, raw JSON)."""
    m = manifests.select("set_id", F.try_parse_json("raw").alias("m"))
    rules = {"malformed": F.col("m").isNull()} | {f"missing {k}": F.col("m").isNotNull() & _falsy("m", k) for k in MANIFEST_KEYS}
    md5, dur, names = _get("m", "source_md5", "string"), _number("m", "duration_sec"), _get("m", "speakers", "array<variant>")
    rules["source_md5 is no 32-digit hex"] = ~_falsy("m", "source_md5") & ~md5.rlike("^[0-9a-fA-F]{32}$")
    there = lambda k: _type("m", k).isNotNull() & (_type("m", k) != "VOID")
    rules["duration_sec is no positive finite number"] = there("duration_sec") & ~F.coalesce(dur > 0, F.lit(False))
    rules["speakers is no list"] = there("speakers") & ~_type("m", "speakers").startswith("ARRAY")
    rules["speakers holds something else than names"] = _type("m", "speakers").startswith("ARRAY") & F.exists(names, lambda x: ~((F.schema_of_variant(x) == "STRING") & _full(F.try_variant_get(x, "$", "string"))))
    rules["segments is no list"] = ~_falsy("m", "segments") & ~_type("m", "segments").startswith("ARRAY")
    top = _errors(m, ["set_id"], rules).select("set_id", F.lit(None).cast("int").alias("place"), "error")
    s = manifest_segments(manifests).join(m.select("set_id", F.when(dur > 0, dur).alias("dur")), "set_id", "left")
    sid = _get("v", "id", "string")
    named = F.coalesce(sid.rlike("^[A-Za-z]{1,2}[0-9]{1,3}$"), F.lit(False))
    s = s.withColumn("_named", named).withColumn("_again", F.row_number().over(Window.partitionBy("set_id", sid, named).orderBy("idx")) > 1)
    a, b, ok = _number("v", "t_start"), _number("v", "t_end"), F.col("_named")
    timed = a.isNotNull() & b.isNotNull()
    reason = _string("v", "reason")
    rules = {
        "id is malformed": ~ok,
        "id is repeated": ok & F.col("_again"),
        "t_start or t_end is no finite number": ok & ~timed,
        "t_end is not after t_start": ok & timed & (b <= a),
        "outside the recording": ok & timed & (b > a) & ((a < 0) | F.coalesce(b > F.col("dur"), F.lit(False))),
        "missing reason": ok & _falsy("v", "reason"),
        "reason is no text": ok & ~_falsy("v", "reason") & ~_full(reason),
    }
    return top.union(_errors(s, ["set_id", "idx"], rules).select("set_id", F.col("idx").alias("place"), "error"))


def line_errors(lines: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """set_id, ord, error, for lines (set_id, ord, raw JSON); with manifests, segments and speakers are held against them."""
    rows = lines.select("set_id", "ord", F.try_parse_json("raw").alias("v"))
    seg, spk = _string("v", "seg"), _get("v", "spk", "string")
    rows = rows.withColumn("_seg", seg).withColumn("_id", _string("v", "id"))
    if manifests is not None:
        bounds = manifest_segments(manifests).select("set_id", _get("v", "id", "string").alias("_seg"), _number("v", "t_start").alias("lo"), _number("v", "t_end").alias("hi")).where("_seg <> '' and lo is not null and hi is not null")
        bounds = bounds.groupBy("set_id", "_seg").agg(F.last("lo").alias("lo"), F.last("hi").alias("hi"))
        roster = manifests.select("set_id", F.from_json(F.get_json_object("raw", "$.speakers"), "array<string>").alias("roster"))
        rows = rows.join(bounds, ["set_id", "_seg"], "left").join(roster, "set_id", "left")
    else:
        rows = rows.withColumn("lo", F.lit(None).cast("double")).withColumn("hi", F.lit(None).cast("double")).withColumn("roster", F.lit(None).cast("array<string>"))
    full = _full(F.col("_id"))
    rows = rows.withColumn("_again", full & (F.row_number().over(Window.partitionBy("set_id", "_id").orderBy("ord")) > 1))
    a, b, ok = _number("v", "t_start"), _number("v", "t_end"), F.col("v").isNotNull()
    timed = a.isNotNull() & b.isNotNull()
    zh, native = (F.trim(F.coalesce(_get("v", k, "string"), F.lit(""))) for k in ("zh", "native"))
    rules = {"malformed JSON or number": ~ok} | {f"missing {k}": ok & _type("v", k).isNull() for k in REQUIRED}
    rules |= {
        "id is no text": ok & _type("v", "id").isNotNull() & ~full,
        "id is repeated": F.col("_again"),
        "t_start or t_end is no number": ok & ~timed,
        "t_end is not after t_start": timed & (b <= a),
        "outside its segment": timed & (b > a) & F.col("lo").isNotNull() & ((a < F.col("lo") - SLACK) | (b > F.col("hi") + SLACK)),
        "unknown seg": ok & F.lit(manifests is not None) & F.col("lo").isNull(),
        "unknown lang": ok & ~F.coalesce(_string("v", "lang").isin(*LANGS), F.lit(False)),
        "unknown spk": ok & F.when(F.size("roster") > 0, ~F.coalesce(F.array_contains("roster", spk) | (spk == "S?"), F.lit(False))).otherwise(~F.coalesce(spk.rlike(r"^S([0-9]+|\?)$"), F.lit(False))),
        "zh is empty": ok & (zh == ""),
        "native equals zh": ok & (native != "") & (native == zh),
        "models is no list of texts": ok & _type("v", "models").isNotNull() & F.coalesce(~_type("v", "models").startswith("ARRAY") | F.exists(_get("v", "models", "array<variant>"), lambda x: F.schema_of_variant(x) != "STRING"), F.lit(True)),
    }
    return _errors(rows, ["set_id", "ord"], rules)
