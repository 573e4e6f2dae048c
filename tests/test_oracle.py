"""Every query of the timeline against its SQL, on the smallest tables."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from chronospan.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(rounded(r[c]) for c in cols) for r in got.collect()), key=str) == sorted((tuple(rounded(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_without_the_corpus_operators(tmp_path):
    """With the subpackage, its tests and the pipeline deleted, the other queries are all there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for name in ("chronospan", "__spark_entry__.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "chronospan/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    for pipeline in (False, True):  # the pipeline's file alone is of no use
        if pipeline:
            (tmp_path / "corpus_pipeline.py").write_text("import chronospan.llm.registry")
        got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
        assert got.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))]


def nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """Pages and movements read the built spans, never the orders; a build deals its rows by allele once and never by panel alone."""
    from chronospan.operators import timeline
    from chronospan.plans import analogue

    for name in ("variants_page", "movement_adjusted", "genes_ranked", "panel_movement", "context_bundle"):
        plan = nodes(QUERIES[name](spark, SF))
        assert "orders.parquet" not in plan and plan.count("assertion_span") <= 2, name
    raw = analogue.built(spark, SF).spans.select("panel", "allele_id", *timeline.DIMENSION, "bucket", "stars", "clnsig_raw", "clnrevstat_raw", F.col("valid_from").alias("release_date"), F.lit("s").alias("snapshot_id"))
    plan = nodes(timeline.sparse_spans(raw, analogue.built(spark, SF).releases))
    assert len(re.findall(r"hashpartitioning\(panel#\d+, allele_id#\d+, \d+\)", plan)) == 1
    assert len(re.findall(r"hashpartitioning\(panel#\d+, \d+\)", plan)) <= 1  # the release list's windows
    assert "BroadcastHashJoin" in plan
