"""The driver contract, and every query against its SQL."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from fernweft.plans import registry
from tools.compare import differences

QUERIES, SQL = registry.queries(), registry.oracle_sql()
REPO = Path(__file__).resolve().parent.parent


def test_flagship_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    assert differences(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_imports_without_training_data_subpackage(tmp_path):
    for part in ("fernweft", "__spark_entry__.py"):
        os.symlink(REPO / part, tmp_path / part) if part.endswith(".py") else None
    copy = tmp_path / "fernweft"
    copy.mkdir()
    for part in (REPO / "fernweft").iterdir():
        if part.name != "llm":
            os.symlink(part, copy / part.name)
    code = "import __spark_entry__ as e; assert 'j1_star_join' in e.queries(); assert not [q for q in e.queries() if q.startswith('op')]; assert 'pipeline' not in e.queries()"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
