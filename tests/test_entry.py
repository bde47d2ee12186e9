import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sql_only_for_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    if os.path.isdir(__spark_entry__.SMOKE_DIR):
        assert __spark_entry__.entry(spark).count() == 40


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    for name in ("foliospark", "jobs", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "foliospark" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'verify_citations' in q and not any(n.startswith('op') or n == 'pipeline' for n in q if n != 'orphans'); e.oracle_sql()"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
