import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from scrivener.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", ["q_window_cues", "q_touch_anti", "q_overall", "q_by_segment", "q_per_line", "q_costs", "q_islands", "q_levels", "q_validate_errors", "q_golden_load", "q_golden_errors", "q_hyp_dispatch", "q_recap_cues", "q_plan_cuts", "q_adjudicated", "q_store", "q_next_ids", "q_srt_parse", "q_normal_forms"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    a, b = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda x: sorted(map(tuple, x[sorted(x.columns)].astype(str).replace({"nan": "None", "<NA>": "None"}).values))
    assert rows(a) == rows(b) and len(a)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", ["q_adjudicated", "q_verdict_totals", "q_hallucination", "q_per_line", "q_report_json", "q_real_time_factor", "q_native", "q_coverage", "q_model_counts", "q_overall", "q_by_segment", "q_by_segment_without_fillers", "q_window_cues", "q_touch_anti", "q_levels"])
def test_no_join_is_broadcast(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_the_rest_works_without_the_pipeline_operators(tmp_path):
    """Neither folder nor file is there: the entry still imports, with the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/scrivener", tmp_path / "scrivener", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, encoding="utf-8", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True).stdout.split()
    assert out == [str(len(QUERIES)), str(len(ORACLE_SQL)), "False"]


def test_benchmark_items_of_any_length(spark, tmp_path):
    text = "zero one two three four five six seven eight nine ten eleven twelve"
    words = text.split(" ")
    items = [(n, " ".join(words[1 : n + 1])[1:-1]) for n in range(1, 12)] + [(20, "zero two"), (21, "one two four five"), (22, None)]
    spark.createDataFrame([(1, text), (2, "other"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((x.item_id, x.doc_id) for x in QUERIES["q_benchmark_in_docs"](spark, str(tmp_path)).collect())
    want = sorted((i, k) for i, t in items if t is not None for k, d in ((1, text), (2, "other")) if t in d)
    assert got == want
