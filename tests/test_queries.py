"""Every registered query with SQL against DuckDB on the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from seepkit.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == columns
    want = [tuple(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall()]
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    """The folder ``seepkit/llm`` may be missing while the pipeline's file is still there."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "seepkit", tmp_path / "seepkit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("from seepkit.llm.names import named\n")
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'wilson_by_flag' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q); print(len(q))"
    made = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert made.returncode == 0, made.stderr
    assert int(made.stdout) == len(catalog.QUERIES)


def test_capsule_pairs_by_rounded_gaps(spark, tmp_path):
    """Two bodies whose gap, 0.0500000545, rounds to the limit of 0.05, and some others."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT unnest([7012, 8386] || range(60))::BIGINT AS vec_id, 4::INT AS label) TO '{tmp_path}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.sql(f"SELECT trial, i, j, gap FROM ({catalog.ORACLES['capsule_pairs']})").fetchall()
    got = [tuple(r) for r in catalog.capsule_pairs(spark, str(tmp_path)).select("trial", "i", "j", "gap").collect()]
    assert (4, 7012, 8386, 0.05) in want
    assert sorted(got) == sorted(want)
