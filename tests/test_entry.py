"""The driver's contract: queries against their SQL at the smallest scale, and imports without optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).parents[1]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["mask_table_default", "pseudo_2_mask_4", "value_scan_mixed", "text_scan_documents", "text_scan_pseudo", "name_scan_prefix", "preview_columns", "auto_match_customer", "normalize_default", "template_suffix", "pseudo_join"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = df.select(*(f"`{c}`" for c in columns)).collect()
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_optional_parts(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e, tessera.plans.files, tessera.streaming.masking; assert 'mask_name' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries()); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": ""}).returncode == 0
