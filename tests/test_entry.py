"""The driver's entry points, with and without the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
from tests.conftest import ROOT


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"] and df.count() == 10


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(x.startswith('op') or x == 'pipeline' for x in q), list(q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
