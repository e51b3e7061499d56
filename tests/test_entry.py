"""The driver's entry, with and without the training-data part."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

HOME = os.path.dirname(os.path.abspath(entry.__file__))


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).first()["count"] >= 0


def test_import_without_the_other_part(tmp_path):
    shutil.copy(os.path.join(HOME, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(HOME, "spandrel"), tmp_path / "spandrel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql(); assert not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
