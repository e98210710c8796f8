"""The library without its training-data part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_entry_imports_without_the_training_data_part(tmp_path):
    kept = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "*.json", "*.txt")
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=kept)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'user_item_stats' in q; print(len(q), [n for n in q if n.startswith('op')], 'pipeline' in q)"
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    count, rest = run.stdout.split(" ", 1)
    assert int(count) >= 99 and rest.strip() == "[] False"
