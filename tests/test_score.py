"""The golden set of two segments, and what known changes to it must do to the scores."""

import pytest
from pyspark.sql import functions as F

from scrivener.functions.text import normal
from scrivener.operators.score import report_json, score

SEGMENTS = [("T", "S1", 0.0, 60.0, "clear"), ("T", "S2", 100.0, 160.0, "dialect")]
LINES = [
    ("T", "S1", "S1-01", 1, 2.0, 8.0, "S1", "zho", "這批MX-K的庫存還有九個", None, ["MX-K"]),
    ("T", "S1", "S1-02", 2, 10.0, 16.0, "S2", "zho", "二零四D的開模下週才會好", None, ["204-D"]),
    ("T", "S2", "S2-01", 3, 102.0, 108.0, "S1", "nan", "網路線沒有這個問題", "網路線無迄個問題", []),
    ("T", "S2", "S2-02", 4, 110.0, 116.0, "S3", "nan", "那個插座要先送去電鍍", "彼个插座愛先送去電鍍", []),
]
SEG_SCHEMA = "set_id string, seg string, t_start double, t_end double, reason string"
LINE_SCHEMA = "set_id string, seg string, id string, ord int, t_start double, t_end double, spk string, lang string, zh string, native string, models array<string>"
CUE_SCHEMA = "set_id string, hyp_id string, ord int, start double, end double, text string, end_estimated boolean"
SELF = [(x[4], x[5], x[8]) for x in LINES]


def tenth(cues):
    n, out = 0, []
    for a, b, t in cues:
        kept = ""
        for c in normal(t):
            n += 1
            kept += "" if n % 10 == 0 else c
        out.append((a, b, kept))
    return out


CASES = {
    "self": SELF,
    "tenth": tenth(SELF),
    "shifted": [(a + 30, b + 30, t) for a, b, t in SELF],
    "swapped": [(a, b, t.replace("MX-K", "ZZ-9").replace("二零四D", "QQ7")) for a, b, t in SELF],
    "giant": [(52.0, 166.0, "垃圾" * 40 + "".join(t for *_, t in SELF[2:]) + "垃圾" * 40)] + SELF[:2],
    "coarse": SELF[:2] + [(100.0, 160.0, "".join(t for *_, t in SELF[2:]))],
    "pieces": [(a + k * 2.0, a + k * 2.0 + 1.7, t[k * len(t) // 3 : (k + 1) * len(t) // 3]) for a, b, t in SELF for k in range(3)],
    "extra": SELF + [(30.0, 40.0, "多出來的話")],
    "far": SELF + [(400.0, 410.0, "不算")],
    "point": [(11.0, 11.0, SELF[1][2]), SELF[0], *SELF[2:]],
    "native": SELF[:2] + [(x[4], x[5], x[9]) for x in LINES[2:]],
    "estimated": SELF,
}


@pytest.fixture(scope="module")
def reports(spark):
    cues = [("T", name, i, float(a), float(b), t, name == "estimated") for name, rows in CASES.items() for i, (a, b, t) in enumerate(rows)]
    hyps = spark.createDataFrame([("T", n, 60.0, 600.0) for n in [*CASES, "empty"]], "set_id string, hyp_id string, asr_sec double, duration_sec double")
    r = score(spark.createDataFrame(SEGMENTS, SEG_SCHEMA), spark.createDataFrame(LINES, LINE_SCHEMA), spark.createDataFrame(cues, CUE_SCHEMA), hyps)
    seg = {(x.hyp_id, x.seg): x for x in r.by_segment.collect()}
    return {x.hyp_id: x for x in r.overall.collect()}, seg, r.per_line.collect(), r


def test_identity(reports):
    o = reports[0]["self"]
    assert (o.cer_content, o.coverage, o.hallucination, o.model_precision, o.model_recall, o.rtf) == (0, 1, 0, 1, 1, 0.1)


def test_missing_characters_are_counted(reports):
    assert 0.08 <= reports[0]["tenth"].cer_content <= 0.12


def test_no_output_is_undecidable_not_zero(reports):
    o = reports[0]["empty"]
    assert (o.cer_content, o.coverage, o.hallucination, o.hallucination_judged_segments, o.model_precision) == (1, 0, None, 0, None)
    assert reports[1]["empty", "S1"].hallucination_blocked_by == "no_hyp_in_window"


def test_shift_and_swap(reports):
    assert reports[0]["shifted"].coverage < 0.2
    assert reports[0]["swapped"].model_recall == 0


def test_cue_borders_do_not_move_the_scores(reports):
    assert reports[1]["giant", "S2"].cer_content < 0.02 and reports[1]["giant", "S2"].verbosity > 3
    assert reports[0]["pieces"].coverage == 1 and reports[0]["pieces"].cer_content == 0
    coarse = reports[1]["coarse", "S2"]
    assert (coarse.hallucination, coarse.hallucination_blocked_by) == (None, "cue_too_coarse")
    assert reports[0]["coarse"].hallucination_judged_segments == 1


def test_unmatched_output(reports):
    assert reports[1]["extra", "S1"].hallucination == pytest.approx(10 / 22) and reports[1]["extra", "S2"].hallucination == 0
    assert reports[0]["far"].hallucination == 0
    assert reports[1]["estimated", "S1"].hallucination_blocked_by == "end_estimated"


def test_a_point_cue_is_touched_by_every_consumer(reports):
    s = reports[1]["point", "S1"]
    assert (s.cer_content, s.coverage, s.hallucination) == (0, 1, 0)


def test_native_track(reports):
    assert reports[1]["native", "S2"].cer_native == 0 and reports[1]["native", "S2"].taigi_flatten_gap <= 0
    assert reports[1]["self", "S2"].cer_native > 0.2 and reports[1]["self", "S1"].cer_native is None
    assert reports[0]["native"].taigi_hits == 2 and reports[0]["self"].taigi_hits == 0


def test_lines_add_up(reports):
    for (hyp, seg), row in reports[1].items():
        own = [x for x in reports[2] if x.hyp_id == hyp and x.seg == seg]
        assert sum(x.ref_len for x in own) == row.ref_chars
        assert sum(x.dist for x in own) == pytest.approx(row.cer_content * row.ref_chars)


def test_a_segment_without_reference_adds_nothing(spark, reports):
    segs = spark.createDataFrame([*SEGMENTS, ("T", "S3", 200.0, 260.0, "empty")], SEG_SCHEMA)
    cues = spark.createDataFrame([("T", "h", i, a, b, t, False) for i, (a, b, t) in enumerate([*SELF, (210.0, 220.0, "有")])], CUE_SCHEMA)
    r = score(segs, spark.createDataFrame(LINES, LINE_SCHEMA), cues)
    o = r.overall.first()
    assert (o.cer_content, o.ref_empty_segments) == (0, 1)
    assert r.by_segment.where("seg = 'S3'").first().cer_content == 1


def test_report_as_json(reports):
    text = report_json(reports[3]).where(F.col("hyp_id") == "self").first().report
    assert '"cer_content":0.0' in text and '"cer_native":null' in text and '"per_line":[' in text
