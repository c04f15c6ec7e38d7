import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sorted(set(o) - set(q)), sorted(n for n in q if n.startswith('op') or n == 'pipeline'))"


def run(folder):
    env = {**os.environ, "PYTHONPATH": folder, "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", CODE], cwd=folder, env=env, capture_output=True, text=True)


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",), ("corpus_pipeline.py",)])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    ignore = shutil.ignore_patterns(".git", "__pycache__", *gone)
    shutil.copytree(ROOT, tmp_path / "repo", ignore=ignore)
    done = run(str(tmp_path / "repo"))
    assert done.returncode == 0, done.stderr
    n, rest = done.stdout.split(" ", 1)
    assert int(n) > 50 and rest.strip() == "[] []"


@pytest.mark.skipif(not (os.path.exists(f"{ROOT}/tidemark/llm") and os.path.exists(f"{ROOT}/corpus_pipeline.py")), reason="removed")
def test_entry_with_them():
    done = run(ROOT)
    assert done.returncode == 0, done.stderr
    assert done.stdout.count("'op") == 10 and "pipeline" in done.stdout


def test_nothing_else_imports_them():
    for top, _, names in os.walk(f"{ROOT}/tidemark"):
        if os.sep + "llm" not in top:
            for n in names:
                if n.endswith(".py"):
                    assert "tidemark.llm" not in open(f"{top}/{n}").read()


def test_entry_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
