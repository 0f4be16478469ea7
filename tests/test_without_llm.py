"""The library without its training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'pip_loss' in q and not any(x.startswith('op') or x == 'pipeline' for x in q); print(len(q), len(s))"


def test_entry_imports_without_the_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "vecstead", copy / "vecstead", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    for pipeline in (False, True):  # gone with them, or left behind
        if pipeline and (ROOT / "corpus_pipeline.py").exists():
            shutil.copy(ROOT / "corpus_pipeline.py", copy)
        done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
