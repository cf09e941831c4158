import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names, sql = e.queries(), e.oracle_sql()
assert len(names) > 50 and len(sql) > 50 and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0
print("works")
"""


def test_entry_works_without_the_corpus_operators(tmp_path):
    """A copy whose llm folders are gone, with corpus_pipeline.py still there and without it."""
    for name in ("quarrylight", "tests"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    for gone in (None, "corpus_pipeline.py"):
        if gone:
            os.remove(tmp_path / gone)
        env = dict(os.environ, PYTHONPATH=str(tmp_path))
        done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
        assert "works" in done.stdout, done.stderr[-2000:]
