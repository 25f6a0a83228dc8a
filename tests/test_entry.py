"""The entry points, with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry


def test_entry_has_rows(spark, data):
    out = entry.entry(spark)
    assert out.columns == ["word", "delta", "card"] and out.count() > 0


def test_sql_names_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_the_corpus_subpackage(tmp_path):
    here = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(here, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'approx_count_block_part' in q and 'pipeline' not in q and not [x for x in q if x.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", timeout=120).returncode == 0


def test_queries_run_from_any_folder(data, tmp_path):
    """Workers find the package wherever the driver was started, without PYTHONPATH."""
    here = os.path.dirname(os.path.abspath(entry.__file__))
    code = f"""import sys; sys.path.insert(0, {here!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
assert e.entry(spark).count() > 0"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, timeout=240).returncode == 0
