"""Short sets made from `part`, one a part, and their scores in SQL: SQL can align texts this short, and aligns all of them whole.

A part has two segments with up to three lines and one hypothesis of up to five cues, whose texts hold full-width letters, Chinese
numerals, fillers and dialect markers, and whose times hold points, long and missing cues.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "".join(map(chr, range(0x41, 0x5B)))
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in LETTERS)
HAN = "零一二三四五六七八九"


class Sets(NamedTuple):
    segments: DataFrame
    lines: DataFrame
    cues: DataFrame
    hyps: DataFrame


def han(n: Column) -> Column:
    """A number below 100 in Chinese numerals."""
    digit = lambda x: F.translate(x.cast("string"), "0123456789", HAN)
    tens, units = F.floor(n / 10), n % 10
    return F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.when((units > 0) | (tens == 0), digit(units)).otherwise(""))


def sets(spark: SparkSession, sf_dir: str) -> Sets:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"), F.col("p_brand").alias("b"), F.col("p_type").alias("t"), F.col("p_size").alias("z"))
    part = part.repartition("k")  # a small file is read in few tasks, and each part has twenty texts and seven alignments
    none, every = F.lit(None).cast("string"), lambda m, r=0: F.col("k") % m == r
    line = lambda seg, i, a, spk, lang, zh, native, models: F.struct(F.lit(seg).alias("seg"), F.lit(f"L{i}").alias("id"), F.lit(i).alias("ord"), F.lit(a).alias("t_start"), F.lit(a + 6).alias("t_end"), F.lit(spk).alias("spk"), lang.alias("lang"), zh.alias("zh"), native.alias("native"), models.alias("models"))
    own = F.array(
        line("S1", 1, 2.0, "S1", F.lit("zho"), F.col("n"), none, F.array("b")),
        line("S1", 2, 10.0, "S2", F.when(every(3), "nan").otherwise("zho"), F.concat("t", han(F.col("z"))), F.when(every(4), F.concat("t", F.lit("袂"))), F.array("t")),
        line("S2", 3, 70.0, "S1", F.lit("nan"), F.col("b"), F.when(every(5), "  "), F.array("n", "b")),
    )
    lines = part.select(F.col("k").alias("set_id"), F.explode(F.when(every(7), F.slice(own, 1, 2)).otherwise(own)).alias("x")).select("set_id", "x.*")
    cue = lambda i, a, e, text, estimated=F.lit(False), there=F.lit(True): F.when(there, F.struct(F.lit(i).alias("ord"), F.lit(a).alias("start"), e.cast("double").alias("end"), text.alias("text"), estimated.alias("end_estimated")))
    heard = F.array(
        cue(0, 2.0, F.when(every(5), 2).otherwise(8), F.when(every(2), F.col("n")).otherwise(F.concat(F.expr("substr(n, 2)"), F.lit("x")))),
        cue(1, 10.0, F.when(every(6, 1), 59).otherwise(16), F.concat(F.translate("t", LETTERS, WIDE), F.lit(" "), F.col("z").cast("string"), F.lit("呃"))),
        cue(2, 30.0, 30 + F.col("k") % 4, F.lit("迄，ABC")),
        cue(3, 58.0, F.lit(66), F.col("b"), there=~every(17, 2)),
        cue(4, 69.0, F.lit(77), F.when(every(3), "Brand#99 毋").otherwise(F.concat("b", "n")), every(13, 5), ~every(17, 2) & ~every(11, 3)),
    )
    name = F.concat(F.lit("h"), (F.col("k") % 2).cast("string")).alias("hyp_id")
    cues = part.where(~every(19, 3)).select(F.col("k").alias("set_id"), name, F.explode(F.filter(heard, lambda x: x.isNotNull())).alias("x")).select("set_id", "hyp_id", "x.*")
    spans = F.array(*[F.struct(F.lit(s).alias("seg"), F.lit(a).alias("t_start"), F.lit(a + 60).alias("t_end"), F.lit(r).alias("reason")) for s, a, r in (("S1", 0.0, "name"), ("S2", 60.0, "brand"))])
    segments = part.select(F.col("k").alias("set_id"), F.explode(spans).alias("x")).select("set_id", "x.*")
    hyps = part.select(F.col("k").alias("set_id"), name, (F.col("k") % 50).cast("double").alias("asr_sec"), F.when(~every(23, 1), F.lit(120.0)).alias("duration_sec"))
    return Sets(segments, lines, cues, hyps)


#: The sets, in normal form, and all that score() derives from them. `fillers` is replaced by the characters that are dropped.
SQL = """
q AS (SELECT p_partkey AS k, upper(replace(p_name, ' ', '')) AS n, upper(replace(p_brand, '#', '')) AS b, upper(p_type) AS t, p_size::VARCHAR AS z FROM part),
segs AS (SELECT k, 'h' || (k % 2) AS h, seg, w0, w0 + 60 AS w1, reason FROM q, (VALUES ('S1', 0.0::DOUBLE, 'name'), ('S2', 60.0::DOUBLE, 'brand')) s(seg, w0, reason)),
li AS (
  SELECT k, 'S1' AS seg, 'L1' AS id, 1 AS ord, 2.0::DOUBLE AS a, 8.0::DOUBLE AS e, 'S1' AS spk, 'zho' AS lang, n AS zh, n AS nat, false AS own, [b] AS terms FROM q
  UNION ALL SELECT k, 'S1', 'L2', 2, 10.0, 16.0, 'S2', CASE WHEN k % 3 = 0 THEN 'nan' ELSE 'zho' END, t || z, CASE WHEN k % 4 = 0 THEN t || '袂' ELSE t || z END, k % 4 = 0, [t] FROM q
  UNION ALL SELECT k, 'S2', 'L3', 3, 70.0, 76.0, 'S1', 'nan', b, CASE WHEN k % 5 = 0 THEN '' ELSE b END, false, [n, b] FROM q WHERE k % 7 <> 0),
c0 AS (
  SELECT k, 0 AS ord, 2.0::DOUBLE AS s, CASE WHEN k % 5 = 0 THEN 2 ELSE 8 END::DOUBLE AS f, CASE WHEN k % 2 = 0 THEN n ELSE substr(n, 2) || 'X' END AS x, false AS est FROM q
  UNION ALL SELECT k, 1, 10.0, CASE WHEN k % 6 = 1 THEN 59 ELSE 16 END, t || z || '呃', false FROM q
  UNION ALL SELECT k, 2, 30.0, 30 + k % 4, '迄ABC', false FROM q
  UNION ALL SELECT k, 3, 58.0, 66, b, false FROM q WHERE k % 17 <> 2
  UNION ALL SELECT k, 4, 69.0, 77, CASE WHEN k % 3 = 0 THEN 'BRAND99毋' ELSE b || n END, k % 13 = 5 FROM q WHERE k % 17 <> 2 AND k % 11 <> 3),
cu AS (SELECT k, ord, s, f, translate(x, '{fillers}', '') AS x, est FROM c0 WHERE k % 19 <> 3),
win AS (SELECT g.k, g.seg, w0, w1, ord, s, f, x, est, least(f, w1) - greatest(s, w0) AS share FROM segs g JOIN cu c ON c.k = g.k AND CASE WHEN f <= s THEN w0 <= s AND s <= w1 ELSE least(f, w1) > greatest(s, w0) END),
hit AS (SELECT l.k, l.seg, l.id, l.ord AS line, l.a, l.e, l.lang, l.zh, c.ord, c.s, c.f, c.x FROM li l JOIN cu c ON c.k = l.k AND CASE WHEN f <= s THEN a <= s AND s <= e ELSE least(f, e) > greatest(s, a) END),
re AS (SELECT k, seg, string_agg(zh, '' ORDER BY a, ord) AS ref, string_agg(nat, '' ORDER BY a, ord) AS nat, count(*) AS lines, median(e - a) AS med_line, sum(e - a) AS gold, bool_or(own) AS own FROM li GROUP BY ALL),
he AS (SELECT k, seg, string_agg(x, '' ORDER BY s, ord) AS hyp, count(*) AS cues, median(f - s) FILTER (f > s) AS med_cue, bool_or(est) AS est, sum(greatest(0, share)) AS heard FROM win GROUP BY ALL),
lo AS (SELECT k, seg, sum(greatest(0, share)) AS lost FROM win w WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.k = w.k AND h.seg = w.seg AND h.ord = w.ord) GROUP BY ALL),
ne AS (SELECT k, seg, id, zh, e - a AS sec, string_agg(x, '' ORDER BY s, ord) AS x FROM hit GROUP BY ALL),
base AS (
  SELECT g.*, coalesce(ref, '') AS ref, coalesce(nat, '') AS nat, coalesce(hyp, '') AS hyp, coalesce(lines, 0) AS lines, coalesce(cues, 0) AS cues, coalesce(med_line, 0) AS med_line, coalesce(med_cue, 0) AS med_cue,
         coalesce(gold, 0) AS gold, coalesce(own, false) AS own, coalesce(est, false) AS est, coalesce(heard, 0) AS heard, coalesce(lost, 0) AS lost
  FROM segs g LEFT JOIN re USING (k, seg) LEFT JOIN he USING (k, seg) LEFT JOIN lo USING (k, seg)),
p AS (SELECT row_number() OVER () AS pid, ref, hyp FROM (SELECT ref, hyp FROM base UNION SELECT nat, hyp FROM base UNION SELECT zh, x FROM ne)),
v AS (
  SELECT pid, 0 AS i, j::INT AS j, 0 AS v FROM p, LATERAL (SELECT unnest(range(0, length(hyp) + 1)) AS j)
  UNION ALL
  SELECT pid, i, j, min(c - j) OVER (PARTITION BY pid ORDER BY j) + j FROM (
    SELECT v.pid, i + 1 AS i, j, least(v + 1, coalesce(lag(v) OVER (PARTITION BY v.pid ORDER BY j) + (substr(ref, i + 1, 1) <> substr(hyp, j, 1))::INT, v + 1)) AS c
    FROM v JOIN p USING (pid) WHERE i < length(ref))),
d AS (SELECT p.pid, ref, hyp, min(v) AS dist, arg_min(j, v * 1000000 + j) AS j, CASE WHEN ref <> '' THEN min(v) / length(ref) WHEN hyp <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cer FROM v JOIN p USING (pid) WHERE i = length(ref) GROUP BY p.pid, ref, hyp),
back AS (
  SELECT pid, length(ref) AS i, j, NULL::INT AS pos, 0 AS cost FROM d
  UNION ALL
  SELECT pid, CASE WHEN ins THEN i ELSE i - 1 END, CASE WHEN ins OR dia THEN j - 1 ELSE j END, i - 1, CASE WHEN ins THEN 1 WHEN dia THEN differs ELSE 1 END
  FROM (SELECT b.pid, b.i, b.j, coalesce(h.v = l.v + 1, false) AS ins, coalesce(h.v = g.v + (substr(ref, b.i, 1) <> substr(hyp, b.j, 1))::INT, false) AS dia, (substr(ref, b.i, 1) <> substr(hyp, b.j, 1))::INT AS differs
        FROM back b JOIN p ON p.pid = b.pid JOIN v h ON h.pid = b.pid AND h.i = b.i AND h.j = b.j
        LEFT JOIN v l ON l.pid = b.pid AND l.i = b.i AND l.j = b.j - 1 LEFT JOIN v g ON g.pid = b.pid AND g.i = b.i - 1 AND g.j = b.j - 1
        WHERE b.i > 0)),
te AS (SELECT k, seg, unnest(terms) AS term FROM li),
vo AS (SELECT k, list_transform(list_sort(list(DISTINCT struct_pack(a := -length(term), b := term))), lambda x: x.b) AS vocab FROM te GROUP BY k),
f1 AS (SELECT b.k, b.seg, vocab[1] AS v1, vocab[2] AS v2, vocab[3] AS v3, hyp AS t1, replace(hyp, vocab[1], repeat('~', length(vocab[1]))) AS t2 FROM base b JOIN vo USING (k)),
f2 AS (SELECT *, replace(t2, v2, repeat('~', length(v2))) AS t3 FROM f1),
fo AS (
  SELECT k, seg, v1 AS term, (length(t1) - length(replace(t1, v1, ''))) // length(v1) AS n FROM f2 UNION ALL SELECT k, seg, v2, (length(t2) - length(replace(t2, v2, ''))) // length(v2) FROM f2 WHERE v2 IS NOT NULL
  UNION ALL SELECT k, seg, v3, (length(t3) - length(replace(t3, v3, ''))) // length(v3) FROM f2 WHERE v3 IS NOT NULL),
co AS (
  SELECT k, seg, sum(least(r, n))::BIGINT AS tp, sum(greatest(0, n - r))::BIGINT AS fp, sum(greatest(0, r - n))::BIGINT AS fn
  FROM (SELECT k, seg, coalesce(r, 0) AS r, coalesce(n, 0) AS n FROM (SELECT k, seg, term, count(*) AS r FROM te GROUP BY ALL) FULL JOIN (SELECT * FROM fo WHERE n > 0) USING (k, seg, term)) GROUP BY ALL),
cv AS (SELECT k, seg, sum(sec) AS cov FROM ne JOIN d ON d.ref = ne.zh AND d.hyp = ne.x WHERE cer <= 0.5 GROUP BY ALL),
dx AS (SELECT k, seg, string_agg(x, '' ORDER BY s, ord) AS x FROM (SELECT DISTINCT k, seg, ord, s, x FROM hit WHERE lang = 'nan') GROUP BY ALL),
dn AS (SELECT k, seg, sum(e - a) AS sec FROM li WHERE lang = 'nan' GROUP BY ALL),
hits AS (SELECT k, seg, x, length(x) - length(replace(x, '迄', '')) + length(x) - length(replace(x, '毋', '')) AS n FROM dx),
rows_ AS (
  SELECT b.*, dz.dist, dz.cer, dn_.dist AS dist_nat, dn_.cer AS cer_nat, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(cov, 0) AS cov, coalesce(n, 0)::BIGINT AS hits, coalesce(length(x), 0)::BIGINT AS dialect_chars, coalesce(sec, 0)::DOUBLE AS dialect_sec,
         med_line <> 0 AND med_cue > med_line * 4 AS coarse, heard > 0 AND NOT (med_line <> 0 AND med_cue > med_line * 4) AND NOT est AS judged
  FROM base b JOIN d dz ON dz.ref = b.ref AND dz.hyp = b.hyp JOIN d dn_ ON dn_.ref = b.nat AND dn_.hyp = b.hyp LEFT JOIN co USING (k, seg) LEFT JOIN cv USING (k, seg) LEFT JOIN hits USING (k, seg) LEFT JOIN dn USING (k, seg))"""


def sql(select: str, fillers: str = "") -> str:
    return f"WITH RECURSIVE {SQL.replace('{fillers}', fillers)} {select}"


BY_SEGMENT = """SELECT k AS set_id, h AS hyp_id, seg, reason, lines::BIGINT AS lines, cues::BIGINT AS hyp_segments, cer AS cer_content, CASE WHEN ref <> '' THEN length(hyp) / length(ref) END AS verbosity, length(ref)::BIGINT AS ref_chars, length(hyp)::BIGINT AS hyp_chars,
  CASE WHEN own THEN cer_nat END AS cer_native, CASE WHEN own THEN cer_nat - cer END AS taigi_flatten_gap, CASE WHEN dialect_chars > 0 THEN hits * 10000.0::DOUBLE / dialect_chars END AS taigi_retention_per10k, hits AS taigi_hits, dialect_chars AS taigi_hyp_chars, dialect_sec AS taigi_sec,
  CASE WHEN gold > 0 THEN cov / gold END AS coverage, CASE WHEN judged THEN lost / heard END AS hallucination, CASE WHEN NOT judged THEN CASE WHEN est THEN 'end_estimated' WHEN coarse THEN 'cue_too_coarse' ELSE 'no_hyp_in_window' END END AS hallucination_blocked_by,
  round(med_cue, 1) AS hyp_median_cue_sec, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS model_precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS model_recall, tp, fp, fn FROM rows_"""

OVERALL = """, allhits AS (SELECT k, string_agg(x, '' ORDER BY s, ord) AS x FROM (SELECT DISTINCT k, ord, s, x FROM hit WHERE lang = 'nan') GROUP BY k),
tot AS (
  SELECT k, h, sum(length(ref)) AS r, sum(length(hyp)) AS y, sum(CASE WHEN ref <> '' THEN dist ELSE 0 END) AS dist, count(*) FILTER (ref = '') AS empty, sum(length(nat)) AS rn, sum(CASE WHEN nat <> '' THEN dist_nat WHEN hyp <> '' THEN 1 ELSE 0 END) AS dn, bool_or(own) AS own,
         sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(cov) AS cov, sum(gold) AS gold, sum(heard) FILTER (judged) AS heard, sum(lost) FILTER (judged) AS lost, count(*) FILTER (judged) AS judged, count(*) AS segs, sum(dialect_sec) AS sec FROM rows_ GROUP BY ALL),
med AS (SELECT k, median(f - s) AS med FROM cu GROUP BY k)
SELECT k AS set_id, h AS hyp_id, coalesce(dist / nullif(r, 0), 0.0::DOUBLE) AS cer_content, y / nullif(r, 0) AS verbosity, r::BIGINT AS ref_chars, y::BIGINT AS hyp_chars, empty AS ref_empty_segments,
  CASE WHEN own THEN coalesce(dn / nullif(rn, 0), 0.0::DOUBLE) END AS cer_native, CASE WHEN own THEN coalesce(dn / nullif(rn, 0), 0.0::DOUBLE) - coalesce(dist / nullif(r, 0), 0.0::DOUBLE) END AS taigi_flatten_gap,
  CASE WHEN length(x) > 0 THEN (length(x) - length(replace(x, '迄', '')) + length(x) - length(replace(x, '毋', ''))) * 10000.0::DOUBLE / length(x) END AS taigi_retention_per10k,
  coalesce(length(x) - length(replace(x, '迄', '')) + length(x) - length(replace(x, '毋', '')), 0)::BIGINT AS taigi_hits, coalesce(length(x), 0)::BIGINT AS taigi_hyp_chars, sec AS taigi_sec,
  cov / nullif(gold, 0) AS coverage, CASE WHEN judged > 0 THEN lost / heard END AS hallucination, judged AS hallucination_judged_segments, segs AS hallucination_total_segments, coalesce(round(med, 1), 0) AS hyp_median_cue_sec,
  tp / nullif(tp + fp, 0) AS model_precision, tp / nullif(tp + fn, 0) AS model_recall, gold AS golden_sec, CASE WHEN k % 23 <> 1 THEN (k % 50) / 120.0::DOUBLE END AS rtf
FROM tot LEFT JOIN allhits USING (k) LEFT JOIN med USING (k)"""

PER_LINE = """SELECT l.k AS set_id, 'h' || (l.k % 2) AS hyp_id, l.seg, l.id, l.lang, l.spk, length(l.zh)::INT AS ref_len, coalesce(sum(cost), 0)::INT AS dist, l.e - l.a AS sec
FROM (SELECT *, coalesce(sum(length(zh)) OVER (PARTITION BY k, seg ORDER BY a, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM li) l
JOIN base b ON b.k = l.k AND b.seg = l.seg JOIN d ON d.ref = b.ref AND d.hyp = b.hyp LEFT JOIN back c ON c.pid = d.pid AND pos >= at_ AND pos < at_ + length(l.zh) GROUP BY ALL"""
