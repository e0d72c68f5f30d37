"""The driver contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "words", "seconds", "duration", "language"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_optional_subpackage(tmp_path):
    for name in ("leafmill", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "leafmill" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not any(x.startswith('op') or x == 'pipeline' for x in n), n"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
