"""The library without its training-data operators."""

import os
import re
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_rest_works_without_llm(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: {n for n in names if n in ("llm", ".git", "__pycache__", ".pytest_cache") or (n == "corpus_pipeline.py" and not pipeline)})
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(o) <= set(q) and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "sitegrid")):
        if os.sep + "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    text = open(os.path.join(folder, n)).read()
                    assert not re.search(r"import.*\bllm\b|\bfrom .*\bllm\b", text), f"{folder}/{n}"
