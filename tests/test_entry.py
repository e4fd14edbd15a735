"""The driver's contract, and that the rest works without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["word", "cnt"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_imports_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'word_count' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_rest_survives_a_missing_package(tmp_path):
    """The optional parts may fail to import for any reason; the other queries stay."""
    (tmp_path / "xxhash.py").write_text("raise ImportError('not there')")
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}, {str(REPO)!r}]; import __spark_entry__ as e; q = e.queries(); assert 'word_count' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, check=True)
