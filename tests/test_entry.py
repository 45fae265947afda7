"""The entry file, with and without the corpus operators."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_corpus_operators():
    code = "import sys; sys.modules['quarry.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'dedup_summary' in q and not any(k.startswith('op') for k in q), q"
    assert subprocess.run([sys.executable, "-c", code], cwd=HERE).returncode == 0
