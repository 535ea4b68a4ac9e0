"""The driver's catalogue: one query for each operator, and its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions.columns import mean_db, ordered_text, overlap, ratio, verdict
from scrivener.functions.text import find_terms_udf, marker_hits, normalized
from scrivener.operators import adjudicate, intervals, levels
from scrivener.operators.score import hallucinated
from scrivener.plans import files, frames, scores  # noqa: F401
from scrivener.plans.frames import BINS, BUCKET, SQL, normal_sql
from scrivener.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from scrivener.sources import store

WINDOW_BINS, WINDOW_SEC = 24, 6.0


def _windowed(spark: SparkSession, d: str) -> DataFrame:
    spans = frames.segments(spark, d).select("set_id", "seg", F.col("t_start").alias("w0"), F.col("t_end").alias("w1"))
    return intervals.touching(spans, frames.cues(spark, d), ["set_id"], span=("w0", "w1"), bucket=BUCKET)


def _in_seconds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, lines, cues)"""
    sec = lambda df, *names: df.select(*[(F.col(x) / 1000.0).alias(x) if x in names else F.col(x) for x in df.columns])
    return sec(frames.segments(spark, d), "t_start", "t_end"), sec(frames.lines(spark, d), "t_start", "t_end"), sec(frames.cues(spark, d), "start", "end")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return intervals.touching(frames.lines(spark, d).drop("ord"), frames.cues(spark, d), ["set_id"], bucket=BUCKET)


@query(f"SELECT doc_id, length({normal_sql('text')})::BIGINT AS n, md5({normal_sql('text')}) AS digest FROM documents")
def q_normalize(spark, d):
    """the normal form of every document."""
    t = frames.table(spark, d, "documents").select("doc_id", normalized("text").alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query(f"WITH {SQL} SELECT set_id, seg, count(*) AS cues, sum(greatest(0, least(\"end\", w1) - greatest(start, w0)))::BIGINT AS ms FROM win GROUP BY ALL")
def q_window_cues(spark, d):
    """Cues of each window, and the time that they share."""
    inside = overlap(F.col("start"), F.col("end"), F.col("w0"), F.col("w1")).cast("long")
    return _windowed(spark, d).groupBy("set_id", "seg").agg(F.count("*").alias("cues"), F.sum(inside).alias("ms"))


@query(f"WITH {SQL} SELECT set_id, id, count(*) AS cues, min(ord) AS first_cue, max(ord) AS last_cue FROM pairs GROUP BY ALL")
def q_touch_inner(spark, d):
    """Cues that touch each line."""
    return _pairs(spark, d).groupBy("set_id", "id").agg(F.count("*").alias("cues"), F.min("ord").alias("first_cue"), F.max("ord").alias("last_cue"))


@query(f"WITH {SQL} SELECT DISTINCT set_id, ord, start FROM pairs WHERE lang = 'nan'")
def q_touch_semi(spark, d):
    """Cues that touch a dialect line, once each."""
    spans = frames.lines(spark, d).where("lang = 'nan'")
    return intervals.touched(spans, frames.cues(spark, d), ["set_id"], ["set_id", "ord"], bucket=BUCKET).select("set_id", "ord", "start")


@query(f"WITH {SQL} SELECT set_id, seg, ord, start FROM win w WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.set_id = w.set_id AND p.seg = w.seg AND p.ord = w.ord)")
def q_touch_anti(spark, d):
    """Cues of a window that touch none of its lines."""
    return intervals.untouched(frames.lines(spark, d), _windowed(spark, d), ["set_id", "seg"], ["set_id", "seg", "ord"], bucket=BUCKET).select("set_id", "seg", "ord", "start")


@query(f"WITH {SQL} SELECT set_id, seg, md5(string_agg({normal_sql('text')}, '' ORDER BY start, ord)) AS digest FROM win GROUP BY ALL")
def q_ordered_concat(spark, d):
    """A1: each window's text in order."""
    rows = _windowed(spark, d).withColumn("norm", normalized("text"))
    return rows.groupBy("set_id", "seg").agg(F.md5(ordered_text(["start", "ord"], "norm")).alias("digest"))


@query("SELECT p_partkey, levenshtein(p_type, p_brand)::BIGINT AS distance FROM part")
def q_levenshtein(spark, d):
    """the edit distance of two texts."""
    return frames.table(spark, d, "part").select("p_partkey", F.levenshtein("p_type", "p_brand").cast("long").alias("distance"))


@query("SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3 + (length(text) - length(replace(text, 'tion', ''))) // 4)::BIGINT AS hits, length(text)::BIGINT AS chars FROM documents")
def q_marker_hits(spark, d):
    """A10: occurrences of markers."""
    t = frames.table(spark, d, "documents")
    return t.select("doc_id", marker_hits(F.col("text"), ("the", "tion")).alias("hits"), F.length("text").cast("long").alias("chars"))


@query(f"WITH {BINS} SELECT rec, win_idx, bins, round(rms, 4) AS rms_db, round(peak, 4) AS peak_db, round(dyn, 4) AS dyn_db, hot FROM wins")
def q_levels(spark, d):
    """Windows of 24 bins."""
    w = levels.windows(frames.bins(spark, d), bin_sec=0.25, window_sec=WINDOW_SEC, present=False)
    return w.select("rec", "win_idx", "bins", F.round("rms_db", 4).alias("rms_db"), F.round("peak_db", 4).alias("peak_db"), F.round("dyn_range_db", 4).alias("dyn_db"), F.rint(F.col("speech_frac") * F.col("bins")).cast("long").alias("hot"))


@query(f"WITH {BINS} SELECT rec, round(floor_db, 6) AS floor_db FROM floors")
def q_floor(spark, d):
    """The noise floor of each recording."""
    return levels.floors(frames.bins(spark, d)).select("rec", F.round("floor_db", 6).alias("floor_db"))


def _ranks(spark, d):
    w = levels.windows(frames.bins(spark, d), bin_sec=0.25, window_sec=WINDOW_SEC, present=False)
    return w.withColumn("rms_db", F.round("rms_db", 6))


@query(f"WITH {BINS} SELECT rec, win_idx, place FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY hot / bins DESC, win_idx) AS place FROM wins) WHERE place <= 8")
def q_top_dense(spark, d):
    """The densest windows of each recording."""
    return levels.densest(_ranks(spark, d)).select("rec", "win_idx", F.col("place").cast("long").alias("place"))


@query(f"WITH {BINS} SELECT rec, win_idx, place FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY round(rms, 6), win_idx) AS place FROM wins WHERE hot / bins >= 0.3) WHERE place <= 8")
def q_top_quiet(spark, d):
    """The quietest windows that hold speech."""
    return levels.quietest(_ranks(spark, d)).select("rec", "win_idx", F.col("place").cast("long").alias("place"))


@query(f"""WITH {BINS}, spans AS (SELECT DISTINCT rec, bin_idx // 20 AS k FROM bins),
m AS (SELECT s.rec, k, count(*) AS n_bins, count(*) FILTER (rms_db > floor_db + 12) AS hot FROM spans s JOIN bins b ON b.rec = s.rec AND b.bin_idx >= k * 20 AND b.bin_idx < k * 20 + 13 JOIN floors f ON f.rec = s.rec GROUP BY ALL)
SELECT rec, k, n_bins, CASE WHEN n_bins < 12 THEN 'undecidable' WHEN hot / n_bins < 0.15 THEN 'true_hallucination' ELSE 'untranscribed_speech' END AS verdict FROM m""")
def q_density_verdict(spark, d):
    """The speech density of spans of 3.1 s in every 5 s, and the verdict."""
    b = frames.bins(spark, d)
    spans = b.select("rec", F.floor(F.col("bin_idx") / 20).alias("k")).distinct().withColumn("start", F.col("k") * 5.0).withColumn("end", F.col("k") * 5.0 + 3.1)
    return levels.speech_density(spans, b, levels.floors(b), ["k"]).select("rec", "k", "n_bins", verdict(F.col("density")).alias("verdict"))


@query(f"""WITH {SQL}, c AS (SELECT set_id, ord, start, "end", max("end") OVER (PARTITION BY set_id ORDER BY start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM cues WHERE role <> 'user'),
n AS (SELECT *, CASE WHEN mx IS NULL OR start - mx > 15000 OR EXISTS (SELECT 1 FROM lines l WHERE l.set_id = c.set_id AND l.lang = 'nan' AND l.t_end > mx AND l.t_start < start) THEN 1 ELSE 0 END AS new FROM c),
i AS (SELECT *, sum(new) OVER (PARTITION BY set_id ORDER BY start, ord ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT set_id, island::BIGINT AS island, min(start)::BIGINT AS start, max("end")::BIGINT AS "end", count(*) AS n_cues, sum("end" - start)::BIGINT AS cue_ms FROM i GROUP BY ALL""")
def q_islands(spark, d):
    """Cues merged over pauses of at most 15 s that hold no dialect line."""
    spans = frames.cues(spark, d).where("role <> 'user'").withColumn("seg", F.lit("all"))
    occupied = frames.lines(spark, d).where("lang = 'nan'").select("set_id", F.col("t_start").alias("lo"), F.col("t_end").alias("hi"))
    runs = adjudicate.merged(spans, occupied, ["set_id"], ["seg"], gap=15_000, bucket=BUCKET)
    return runs.select("set_id", F.col("island").cast("long").alias("island"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n_cues", F.col("cue_sec").cast("long").alias("cue_ms"))


@query(f"""WITH {SQL} SELECT set_id, seg, seg || '-' || lpad((max(ord) + 1)::VARCHAR, 3, '0') AS next_id FROM lines GROUP BY set_id, seg""")
def q_next_ids(spark, d):
    """The next id of each segment."""
    return store.next_ids(frames.lines(spark, d))


@query(f"""WITH {SQL} SELECT set_id, seg, ord, start FROM win w WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.set_id = w.set_id AND p.seg = w.seg AND p.ord = w.ord)""")
def q_hallucinated(spark, d):
    """J4 as the scorer uses it, in seconds."""
    out = hallucinated(*_in_seconds(spark, d))
    return out.select("set_id", "seg", "ord", F.rint(F.col("start") * 1000).cast("long").alias("start"))


@query(f"WITH {BINS} SELECT rec, round(10 * log10(avg(pow(10.0, rms_db / 10))), 4) AS mean_db, round(median(rms_db), 6) AS median_db, count(*) AS bins FROM bins GROUP BY rec")
def q_mean_level(spark, d):
    """A2, A4: mean power and median of each recording."""
    return frames.bins(spark, d).groupBy("rec").agg(F.round(mean_db(F.col("rms_db")), 4).alias("mean_db"), F.round(F.median("rms_db"), 6).alias("median_db"), F.count("*").alias("bins"))


@query(f"WITH {SQL} SELECT set_id, sum(\"end\" - start)::BIGINT AS ms, count(*) FILTER (role = 'user') / nullif(count(*) FILTER (role <> 'user'), 0) AS share FROM cues GROUP BY ALL")
def q_ratio(spark, d):
    """Ratios that are NULL where nothing divides."""
    c = frames.cues(spark, d).groupBy("set_id").agg(F.sum(F.col("end") - F.col("start")).alias("ms"), F.count(F.when(F.col("role") == "user", 1)).alias("u"), F.count(F.when(F.col("role") != "user", 1)).alias("o"))
    return c.select("set_id", "ms", ratio(F.col("u"), F.col("o")).alias("share"))


ADJUDICATED = f"""WITH {SQL}, bins AS (SELECT set_id, bin_idx, CASE WHEN bin_idx // 16 % 3 = 0 THEN -20.0::DOUBLE ELSE -60.0::DOUBLE - bin_idx % 5 END AS rms_db FROM (SELECT set_id, unnest(range(0, max("end") // 250 + 1)) AS bin_idx FROM cues GROUP BY set_id)),
floors AS (SELECT set_id, quantile_cont(rms_db, 0.1) AS floor_db FROM bins GROUP BY set_id),
lost AS (SELECT set_id, seg, ord, text, start / 1000.0::DOUBLE AS s, "end" / 1000.0::DOUBLE AS e FROM win w WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.set_id = w.set_id AND p.seg = w.seg AND p.ord = w.ord)),
m AS (SELECT *, max(e) OVER (PARTITION BY set_id, seg ORDER BY s, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM lost),
n AS (SELECT *, CASE WHEN mx IS NULL OR s - mx > 0.5 OR EXISTS (SELECT 1 FROM lines l WHERE l.set_id = m.set_id AND l.t_end / 1000.0::DOUBLE > mx AND l.t_start / 1000.0::DOUBLE < s) THEN 1 ELSE 0 END AS new FROM m),
i AS (SELECT *, sum(new) OVER (PARTITION BY set_id, seg ORDER BY s, ord ROWS UNBOUNDED PRECEDING) AS island FROM n),
r AS (SELECT set_id, seg, island, min(s) AS start, max(e) AS "end", string_agg(text, '' ORDER BY s, ord) AS text, count(*) AS n_cues, round(sum(e - s), 2) AS cue_sec FROM i GROUP BY ALL),
a AS (
  SELECT set_id, seg, island, count(*) AS n_bins, count(*) FILTER (rms_db > floor_db + 12) AS hot FROM r JOIN bins b USING (set_id) JOIN floors USING (set_id)
  WHERE bin_idx >= floor(start / 0.25) AND bin_idx < greatest(floor(start / 0.25) + 1, ceil("end" / 0.25)) GROUP BY ALL),
v AS (SELECT r.*, coalesce(n_bins, 0) AS n_bins, CASE WHEN n_bins >= 12 THEN hot / n_bins END AS density FROM r LEFT JOIN a USING (set_id, seg, island)),
w AS (SELECT set_id, 'h' AS hyp_id, seg, start, "end", cue_sec, round(greatest(0, "end" - start), 2) AS span_sec, n_cues, md5({normal_sql("text")}) AS text, density, n_bins, CASE WHEN density IS NULL THEN 'undecidable' WHEN density < 0.15 THEN 'true_hallucination' ELSE 'untranscribed_speech' END AS verdict FROM v)"""


def _adjudicated(spark, d):
    s, l, c = _in_seconds(spark, d)
    bins = c.groupBy(F.col("set_id").alias("rec")).agg(F.max("end").alias("end")).select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("end") / 0.25))).alias("bin_idx"))
    bins = bins.withColumn("rms_db", F.when(F.floor(F.col("bin_idx") / 16) % 3 == 0, -20.0).otherwise(-60.0 - F.col("bin_idx") % 5)).withColumn("peak_db", F.col("rms_db"))
    return adjudicate.adjudicate(s, l, c, bins, levels.floors(bins))


@query(f"{ADJUDICATED} SELECT * FROM w")
def q_adjudicated(spark, d):
    """Unmatched runs of cues, the density of speech under each, and the verdict."""
    return _adjudicated(spark, d).withColumn("text", F.md5("text"))


@query(f"{ADJUDICATED} SELECT set_id, hyp_id, verdict, round(sum(cue_sec), 2) AS cue_sec, count(*) AS spans FROM w GROUP BY ALL")
def q_verdict_totals(spark, d):
    """Unmatched time by verdict."""
    return adjudicate.verdict_totals(_adjudicated(spark, d)).withColumn("cue_sec", F.round("cue_sec", 2))


def _find_terms_sql(terms: tuple[str, ...]) -> str:
    order, text, found = sorted(terms, key=lambda x: (-len(x), x)), "t", []
    for x in order:
        found.append(f"SELECT doc_id, '{x}' AS term, ((length({text}) - length(replace({text}, '{x}', ''))) // {len(x)})::INT AS n FROM d")
        text = f"replace({text}, '{x}', '{'~' * len(x)}')"
    return f"WITH d AS (SELECT doc_id, {normal_sql('text')} AS t FROM documents) SELECT * FROM ({' UNION ALL '.join(found)}) WHERE n > 0"


TERMS = ("THE", "THENT", "TION", "ATION", "ENT")


@query(_find_terms_sql(TERMS))
def q_find_terms(spark, d):
    """terms in every document, longest first, what is taken is gone."""
    t = frames.table(spark, d, "documents").select("doc_id", normalized("text").alias("t"))
    return t.select("doc_id", F.explode(find_terms_udf("t", F.array(*map(F.lit, TERMS)))).alias("term", "n"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def q_benchmark_in_docs(spark, d):
    """Verbatim hits: benchmark items that lie in a document without an edit. A pair is looked at only if the document has the item's
    words 2 to 9, or of a shorter item all between its first and last; items without such words meet every document."""
    hashed = lambda t: F.transform(F.split(t, r"\s+"), lambda x: F.xxhash64(x))
    run = lambda at, m: "xxhash64(" + ", ".join(f"w[{at} + {i}]" for i in range(m)) + ")"
    docs = frames.table(spark, d, "documents").where("text is not null").select("doc_id", "text", hashed("text").alias("w"))
    items = frames.table(spark, d, "benchmark").where("text is not null").select("item_id", F.col("text").alias("item"), hashed("text").alias("w"))
    items = items.withColumn("m", F.least(F.lit(8), F.size("w") - 2))
    # inner words of an item are whole words of a document that holds it
    pairs = docs.select("doc_id", "text").crossJoin(items.where("m < 1").select("item_id", "item"))
    for m in sorted(x.m for x in items.where("m >= 1").select("m").distinct().collect()):  # 8 lengths at most
        runs = docs.where(F.size("w") >= m).select("doc_id", "text", F.explode(F.array_distinct(F.expr(f"transform(sequence(0, size(w) - {m}), i -> {run('i', m)})"))).alias("g"))
        own = items.where(F.col("m") == m).select("item_id", "item", F.expr(run("1", m)).alias("g"))
        pairs = pairs.union(runs.join(own, "g").select("doc_id", "text", "item_id", "item"))
    return pairs.where(F.contains("text", "item")).select("item_id", "doc_id")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.q_overall(spark, sf_dir)
