"""The library without its training-data part, and entry points that know all of it."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_works_without_the_training_data_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".*"))
    assert (copy / "corpus_pipeline.py").exists() and not (copy / "lodestrata/llm").exists()
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) < set(q) and 'pipeline' not in q; import bench"
    for also in (False, True):  # with and without the pipeline's file
        if also:
            (copy / "corpus_pipeline.py").unlink()
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_the_training_data_part():
    for folder, _, names in os.walk(os.path.join(ROOT, "lodestrata")):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "llm" not in f.read(), name
