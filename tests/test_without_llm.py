"""The library without its corpus part: both folders, and the pipeline too or not, taken out of a copy."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
from matchloom.plans import catalog
assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.oracles())
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0
"""


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_entry_without_llm(tmp_path, pipeline_too):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json"))
    if pipeline_too:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    env = os.environ | {"PYTHONPATH": str(copy)}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
