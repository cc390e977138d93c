"""The core stands without the training-data operators."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_core_without_training_data_operators(tmp_path):
    shutil.copytree(REPO / "siltstone", tmp_path / "siltstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('p1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_them():
    for path in (REPO / "siltstone").rglob("*.py"):
        if "llm" not in path.relative_to(REPO / "siltstone").parts:
            assert not re.search(r"^\s*(?:from|import)\s+siltstone\.llm|from siltstone import .*\bllm\b", path.read_text(), re.M)
