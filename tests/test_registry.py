import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from ledgerlens.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_every_statement_has_its_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(catalogue.queries()) <= set(entry_points.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["p5_found", "bm25_topk", "term_idf", "search_modes", "panorama_rank", "page_segments", "manifest_rows", "int8_cosine", "search_hybrid", "search_grouped", "panorama_table", "report_chunks", "extractive_answer", "eval_summary", "bm25_stored"])
def test_queries_equal_their_statements(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    df = catalogue.queries()[name](spark, DATA)
    assert set(columns) == set(df.columns)
    assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    """Without the setting a folder of the machine is taken in one JVM only."""
    from types import SimpleNamespace

    from ledgerlens import runtime

    taken = []
    none = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
    session = lambda master, conf: SimpleNamespace(sparkContext=SimpleNamespace(_jsc=none, master=master, setCheckpointDir=taken.append), conf=SimpleNamespace(get=lambda k, d: conf))
    with pytest.raises(RuntimeError):
        runtime.shared_dir(session("spark://host:7077", None))
    runtime.shared_dir(session("local[4]", None))
    assert runtime.shared_dir(session("yarn", "hdfs://x/y")) == "hdfs://x/y" == taken[-1] and len(taken) == 2


def test_no_query_compares_everything_with_everything(spark):
    """Plans of the joins by containment and filter hold no nested loops or cartesian products."""
    for name in ("gold_containment", "filter_detect", "filter_fallback", "missing_companies", "bm25_filtered"):
        plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().toString()
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
