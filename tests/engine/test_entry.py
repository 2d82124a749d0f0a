"""The entry module without the parts that can be left out."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SAY = "import __spark_entry__ as e; q = set(e.queries()); print(len(q), any(x.startswith('op1_') for x in q), 'pipeline' in q, set(e.oracle_sql()) <= q)"


def copied(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("__pycache__"))


def said(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()


@pytest.mark.parametrize("left_out", ["folder", "all but a cache", "a library"])
def test_without_the_training_operators(tmp_path, left_out):
    copied(tmp_path)
    if left_out == "a library":
        (tmp_path / "xxhash.py").write_text("raise ImportError('no xxhash')\n")
    else:
        shutil.rmtree(tmp_path / "lodestone" / "llm", ignore_errors=True)
        if left_out == "all but a cache":
            (tmp_path / "lodestone" / "llm" / "__pycache__").mkdir(parents=True)
    n, op1, pipeline, oracles = said(tmp_path)
    assert int(n) > 70 and (op1, pipeline, oracles) == ("False", "False", "True")
