"""Intervals, levels, islands, cuts, validation, readers, store, lint."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrivener.functions.columns import clock, seconds
from scrivener.operators import adjudicate, chunks, intervals, levels, lint, validate
from scrivener.sources import readers, store


def test_touching_by_buckets_equals_all_pairs(spark):
    import random

    rng = random.Random(3)
    a = [(i, float(x := rng.randrange(0, 400)), float(x + rng.choice([0, 1, 30, 60, 130]))) for i in range(150)]
    c = [(i, float(x := rng.randrange(-20, 420)), float(x + rng.choice([0, 0, -5, 20, 60, 200]))) for i in range(150)]
    got = intervals.touching(spark.createDataFrame([(1, *x) for x in a], "r int, i int, t_start double, t_end double"), spark.createDataFrame([(1, *x) for x in c], "r int, j int, start double, end double"), ["r"])
    hit = lambda s, e, x, y: x <= s <= y if e <= s else min(e, y) > max(s, x)
    assert sorted((x.i, x.j) for x in got.collect()) == sorted((i, j) for i, x, y in a for j, s, e in c if hit(s, e, x, y))


def test_levels(spark):
    b = spark.createDataFrame([("r", i, float(v), float(v) + 3) for i, v in enumerate([-20, -60, -20, -60, -30, -30, -30, -30, -50])], "rec string, bin_idx long, rms_db double, peak_db double")
    w = levels.windows(b, window_sec=1.0).orderBy("win_idx").collect()
    assert [x.bins for x in w] == [4, 4, 1] and w[-1].t_end == 2.25 and w[0].rms_db == pytest.approx(-23.01, abs=0.01)
    assert levels.floors(b.where("bin_idx < 2"), 25).first().floor_db == -50
    assert [x.win_idx for x in levels.densest(levels.windows(b, window_sec=1.0)).orderBy('place').collect()] == [1, 0, 2]
    spans = spark.createDataFrame([("r", 1, 0.0, 3.1), ("r", 2, 0.0, 1.0)], "rec string, k int, start double, end double")
    bins = spark.createDataFrame([("r", i, -10.0 if i in (0, 12) else -80.0, 0.0) for i in range(20)], "rec string, bin_idx long, rms_db double, peak_db double")
    floor = spark.createDataFrame([("r", -80.0)], "rec string, floor_db double")
    d = {x.k: x for x in levels.speech_density(spans, bins, floor, ["k"]).collect()}
    assert d[1].density == pytest.approx(2 / 13) and d[1].n_bins == 13 and d[2].density is None


def test_clocks(spark):
    row = spark.range(1).select(seconds(F.lit("1:33:27")).alias("a"), seconds(F.lit("93:27")).alias("b"), clock(F.lit(3661.4)).alias("c")).first()
    assert (row.a, row.b, row.c) == (5607.0, 5607.0, "1:01:01")


def test_islands_equal_the_fold(spark):
    import random

    rng, spans, lines = random.Random(5), [], []
    for rec in range(20):
        for i in range(15):
            s = rng.randrange(0, 60) / 4
            spans.append((rec, "h", "S1", i, s, s + rng.randrange(0, 8) / 4, str(i % 10)))
        lines += [(rec, x := rng.randrange(0, 60) / 4, x + 0.5) for _ in range(3)]
    got = adjudicate.merged(spark.createDataFrame(spans, "set_id int, hyp_id string, seg string, ord int, start double, end double, text string"), spark.createDataFrame(lines, "set_id int, lo double, hi double"), ["set_id"], ["hyp_id", "seg"])
    want = []
    for rec in range(20):
        runs = []
        for _, _, _, i, s, e, t in sorted((x for x in spans if x[0] == rec), key=lambda x: x[4]):
            blocked = runs and any(hi > runs[-1][1] and lo < s for r, lo, hi in lines if r == rec)
            if runs and s - runs[-1][1] <= 0.5 and not blocked:
                runs[-1] = [runs[-1][0], max(runs[-1][1], e), runs[-1][2] + t]
            else:
                runs.append([s, e, t])
        want += [(rec, *x) for x in runs]
    assert sorted((x.set_id, x.start, x.end, x.text) for x in got.collect()) == sorted(want)


def test_cut_plan_examples(spark):
    assert chunks.cut_points(300, [58, 97, 112], 100, 45, 15, 10)[0] == 97
    assert chunks.cut_points(3, [], 1, 0, 0, 2) == [3.0] and chunks.cut_points(50, [20], 100) == [50.0]
    assert chunks.cut_points(2.0, [2.0], 1.0, 0.0, 1.0, 0.0) == [2.0]  # a cut at the very end is the end
    for bad in (math.nan, math.inf, -1.0, 0.0):
        with pytest.raises(ValueError):
            chunks.cut_points(bad, [])
    plan = chunks.plan(spark.createDataFrame([("a", 250.0), ("b", 40.0)], "rec string, duration double"), spark.createDataFrame([("a", 95.0), ("a", 190.0)], "rec string, at double"), 100, 45, 15, 10)
    assert [(x.rec, x.start, x.end) for x in plan.orderBy("rec", "index").collect()] == [("a", 0, 95), ("a", 95, 190), ("a", 190, 250), ("b", 0, 40)]
    assert chunks.chunks(plan).agg(F.sum("duration")).first()[0] == pytest.approx(290)


@settings(max_examples=300, deadline=None)
@given(st.floats(1, 5000), st.lists(st.floats(0, 5000), max_size=40), st.floats(1, 600), st.floats(0, 60), st.floats(0, 60), st.floats(0, 200))
def test_cut_plan_partitions(total, quiet, longest, back, forward, shortest):
    ends = chunks.cut_points(total, quiet, longest, back, forward, shortest)
    starts = [0.0, *ends[:-1]]
    assert ends[-1] == total and all(a < b for a, b in zip(starts, ends, strict=True))
    assert len(ends) == 1 or all(b - a >= shortest - 1e-9 for a, b in zip(starts, ends, strict=True))


GOOD = {"id": "S1-01", "seg": "S1", "t_start": 2.0, "t_end": 8.0, "spk": "S1", "lang": "zho", "zh": "好"}
MANIFEST = {"set_id": "T", "source_audio": "t.m4a", "source_md5": "0" * 32, "duration_sec": 600.0, "segments": [{"id": "S1", "t_start": 0.0, "t_end": 60.0, "reason": "x"}]}


def test_line_errors(spark):
    cases = [
        ({}, None), ({"zh": None}, "zh is empty"), ({"lang": "xx"}, "unknown lang"), ({"t_end": 2.0}, "t_end is not after t_start"), ({"native": "好"}, "native equals zh"), ({"spk": "Z"}, "unknown spk"), ({"seg": "S9"}, "unknown seg"),
        ({"models": "MX"}, "models is no list of texts"), ({"t_end": 70.0}, "outside its segment"), ({"t_start": True}, "t_start or t_end is no number"), ({"id": " "}, "id is no text"), ({"t_end": 1e999}, "malformed JSON or number"), ({"spk": "S?"}, None),
    ]
    rows = [("T", i, json.dumps(GOOD | {"id": f"L{i}"} | x)) for i, (x, _) in enumerate(cases)]
    rows += [("T", 98, json.dumps({k: v for k, v in GOOD.items() if k != "zh"})), ("T", 99, json.dumps(GOOD | {"id": "L0"}))]
    m = spark.createDataFrame([("T", json.dumps(MANIFEST))], "set_id string, raw string")
    found = {}
    for x in validate.line_errors(spark.createDataFrame(rows, "set_id string, ord int, raw string"), m).collect():
        found.setdefault(x.ord, set()).add(x.error)
    for i, (x, error) in enumerate(cases):
        if error == "malformed JSON or number":
            assert found[i] & {error, "t_start or t_end is no number"}, x
        else:
            assert (error in found.get(i, ())) if error else i not in found, (x, found.get(i))
    assert found[98] == {"missing zh", "zh is empty"} and found[99] == {"id is repeated"}


def test_manifest_errors(spark):
    seg = MANIFEST["segments"][0]
    cases = [
        ({}, None), ({"source_md5": "x"}, "source_md5 is no 32-digit hex"), ({"duration_sec": -1}, "duration_sec is no positive finite number"), ({"duration_sec": None}, "missing duration_sec"), ({"speakers": "A"}, "speakers is no list"), ({"speakers": ["A", " "]}, "speakers holds something else than names"),
        ({"segments": "x"}, "segments is no list"), ({"segments": [seg, seg]}, "id is repeated"), ({"segments": [seg | {"t_end": 700.0}]}, "outside the recording"), ({"segments": [seg | {"reason": 1}]}, "reason is no text"), ({"segments": [seg | {"id": "long1"}]}, "id is malformed"),
    ]
    rows = [(str(i), json.dumps(MANIFEST | x)) for i, (x, _) in enumerate(cases)]
    found = {}
    for x in validate.manifest_errors(spark.createDataFrame(rows, "set_id string, raw string")).collect():
        found.setdefault(int(x.set_id), set()).add(x.error)
    for i, (x, error) in enumerate(cases):
        assert (error in found.get(i, ())) if error else i not in found, (x, found.get(i))


SRT = "1\r\n00:00:02,000 --> 00:00:08,000\r\n甲\r\n乙\r\n\r\n \r\n2\r\n00:00:10.5 --> 00:00:16,250\r\n丙\r\n\r\nno time\r\n"
RECAP = "# 摘要\n**A**（9:59）\n不算\n## 逐字稿\n**甲**（0:10）\n你好\n嗨\n\n**乙**(0:14)\n嗯\n## 完\n略\n**甲**（1:00）\n再見\n"


def test_readers(spark, tmp_path):
    for name, text in (("a.srt", "﻿" + SRT), ("b.md", RECAP), ("c.json", json.dumps({"segments": [{"start": 1, "end": 2, "text": "x"}, {"start": None, "end": 2}, {"start": 3, "end": 4, "text": None}]}))):
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = lambda n: [(x.start, x.end, x.text) for x in readers.load_hyp(spark, str(tmp_path / n)).orderBy("ord").collect()]
    assert got("a.srt") == [(2.0, 8.0, "甲 乙"), (10.005, 16.25, "丙")]
    assert got("b.md") == [(10.0, 14.0, "你好 嗨"), (14.0, 60.0, "嗯"), (60.0, 106.0, "再見")]
    assert got("c.json") == [(1.0, 2.0, "x"), (3.0, 4.0, "")]
    assert readers.load_hyp(spark, str(tmp_path / "b.md")).where("end_estimated").count() == 3


def test_golden_directory(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps(MANIFEST))
    (tmp_path / "lines.jsonl").write_text(json.dumps(GOOD) + "\n\n" + json.dumps(GOOD | {"id": "S1-02"}) + "\n")
    _, segments, lines = readers.load_golden(spark, str(tmp_path))
    assert segments.first().seg == "S1" and lines.count() == 2
    (tmp_path / "lines.jsonl").write_text("{broken\n" + json.dumps(GOOD | {"lang": "x"}) + "\n")
    with pytest.raises(readers.GoldenError) as e:
        readers.load_golden(spark, str(tmp_path))
    assert "line 1: malformed" in str(e.value) and "line 2: unknown lang" in str(e.value)


def test_logs(spark):
    log = "lavfi.astats.Overall.RMS_level=-inf\nlavfi.astats.Overall.Peak_level=-3.5\nlavfi.astats.Overall.RMS_level=-20.25\n"
    bins = readers.level_bins(spark.createDataFrame([("r", log)], "rec string, raw string")).orderBy("bin_idx").collect()
    assert [(x.rms_db, x.peak_db) for x in bins] == [(-120.0, -120.0), (-20.25, -20.25)]
    with pytest.raises(Exception, match="no levels"):
        readers.level_bins(spark.createDataFrame([("r", "nothing")], "rec string, raw string")).collect()
    quiet = "silence_start: 20.0\nsilence_end: 22.000062 |\nsilence_start: 50\n"
    assert readers.silences(spark.createDataFrame([("r", quiet)], "rec string, raw string")).first().at == pytest.approx(21.000031)


def test_store_keeps_ten_versions(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = lambda n: spark.createDataFrame([("T", i, json.dumps(GOOD | {"id": f"L{i}", "zh": "（範例）" if i == 0 else "好"})) for i in range(n)], "set_id string, ord int, raw string")
    assert store.save(rows(0), root) and store.read(spark, root).count() == 0
    for n in range(2, 14):
        assert store.save(rows(n), root) == []
    assert len(store.versions(spark, root)) == 10 and store.read(spark, root).count() == 12
    assert store.save(rows(3).withColumn("raw", F.lit("{")), root) and store.read(spark, root).count() == 12


def test_lint(spark):
    head = "import subprocess\nimport subprocess as sp\nimport os as o\nfrom subprocess import run as r, getoutput\n"
    bad = ["sp.run(x, text=True)", "r(x, universal_newlines=FLAG)", "getoutput(x)", "o.popen(x)", "subprocess.Popen(x, text=1, encoding=None)", "sp.getstatusoutput(x)"]
    good = ["sp.run(x)", "r(x, text=False)", "sp.run(x, text=True, encoding='utf-8')", "o.system(x)", "other.run(x, text=True)"]
    for code in bad:
        assert len(lint.violations(head + code)) == 1, code
    for code in good:
        assert not lint.violations(head + code), code
    files = [("a.py", (head + bad[0]).encode("utf-8-sig")), ("b.py", b"def ("), ("c.py", "# coding: cp950\n".encode() + "x = '中'\n".encode("cp950")), ("d.py", b"x = '\xff'")]
    rows = lint.lint(spark.createDataFrame(files, "path string, content binary")).collect()
    assert {(x.path, x.error is None) for x in rows} == {("a.py", True), ("b.py", False), ("d.py", False)}


def test_streamed_levels(spark, tmp_path):
    from scrivener.streaming.levels import windows

    rows = spark.sql("select 'r' as rec, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) as ts, -20.0D as rms_db, -3.0D as peak_db from range(180)")
    rows.write.parquet(str(tmp_path / "in"))
    q = windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").outputMode("complete").queryName("levels").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((x.bins, round(x.rms_db)) for x in spark.table("levels").collect()) == [(60, -20)] * 3


def test_every_error_is_listed_or_counted(spark, tmp_path):
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "manifest.json").write_text("{}")
    (tmp_path / "set" / "lines.jsonl").write_text("[\n" * 1500)
    with pytest.raises(readers.GoldenError, match="the first 1000 of 1505 errors"):
        readers.load_golden(spark, str(tmp_path / "set"), shown=1000)
    with pytest.raises(readers.GoldenError) as e:
        readers.load_golden(spark, str(tmp_path / "set"))
    assert str(e.value).count("malformed JSON") == 1500 and str(e.value).count("manifest: missing") == 5
    lines = spark.createDataFrame([("s", i, "[") for i in range(1500)], "set_id string, ord int, raw string")
    assert "the first 1000 of 1500 " in store.save(lines, str(tmp_path / "store"), shown=1000)[-1]
    assert len(store.save(lines, str(tmp_path / "store"))) == 1500


def test_vocabulary_and_shifted_cues(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("﻿ MX-K \r\n\n\t204-D\n   \n", encoding="utf-8")
    assert [x.term for x in readers.load_vocab(spark, str(tmp_path / "terms.txt")).collect()] == ["MX-K", "204-D"]
    moved = chunks.shifted(spark.createDataFrame([(1.0, 2.0, 100.0)], "start double, end double, start_offset double")).first()
    assert (moved.start, moved.end) == (101.0, 102.0)


def test_source_tree(spark, tmp_path):
    for name, text in (("a.py", "import os\nos.popen(1)\nos.popen(2)\n"), ("pkg/b.py", "x = 1\n"), ("pkg/c.txt", "os.popen(1)"), (".git/d.py", "import os\nos.popen(1)\n"), ("pkg/node_modules/e.py", "import os\nos.popen(1)\n"), ("pkg/f.py", "def (\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = readers.source_files(spark, str(tmp_path))
    assert sorted(x.path.rpartition("/")[2] for x in files.collect()) == ["a.py", "b.py", "f.py"]
    found = lint.lint(files)
    assert [(x.path.rpartition("/")[2], x.violations) for x in lint.lint_counts(found).collect()] == [("a.py", 2)]
    assert [x.path.rpartition("/")[2] for x in found.where("error is not null").collect()] == ["f.py"]


def test_adjudication_end_to_end(spark):
    """Two unmatched cues that merge over silence, one over speech, and a short one that can't be judged."""
    segments = spark.createDataFrame([("T", "S1", 0.0, 60.0, "x")], "set_id string, seg string, t_start double, t_end double, reason string")
    lines = spark.createDataFrame([("T", "S1", "L1", 1, 20.0, 24.0)], "set_id string, seg string, id string, ord int, t_start double, t_end double")
    cues = [(0, 1.0, 3.0, "好，"), (1, 3.25, 5.0, "a"), (2, 20.0, 24.0, "matched"), (3, 30.0, 34.0, "b"), (4, 50.0, 51.0, "c")]
    table = spark.createDataFrame([("T", "h", *x) for x in cues], "set_id string, hyp_id string, ord int, start double, end double, text string")
    bins = spark.createDataFrame([("T", i, -20.0 if 120 <= i < 130 else -80.0, 0.0) for i in range(240)], "rec string, bin_idx long, rms_db double, peak_db double")
    rows = adjudicate.adjudicate(segments, lines, table, bins, levels.floors(bins))
    got = [(x.start, x.end, x.cue_sec, x.span_sec, x.n_cues, x.text, x.n_bins, x.verdict) for x in rows.orderBy("start").collect()]
    assert got == [(1.0, 5.0, 3.75, 4.0, 2, "好A", 16, "true_hallucination"), (30.0, 34.0, 4.0, 4.0, 1, "B", 16, "untranscribed_speech"), (50.0, 51.0, 1.0, 1.0, 1, "C", 4, "undecidable")]
    totals = {x.verdict: (x.cue_sec, x.spans) for x in adjudicate.verdict_totals(rows).collect()}
    assert totals == {"true_hallucination": (3.75, 1), "untranscribed_speech": (4.0, 1), "undecidable": (1.0, 1)}
