"""The package away from its own folder."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
from quire.session import local_session
from quire.operators import compare
spark = local_session(1, partitions=1, memory="1g")
sys.path.remove({root!r})
pages = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "doc_id long, page int, text string")
pairs = spark.createDataFrame([(9, 1, 2)], "pair_id long, doc_a long, doc_b long")
print("rows", compare.document_diff(pages, pairs).count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1" in run.stdout, run.stderr[-2000:]


def test_entry_without_the_optional_parts(tmp_path):
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git", "*.json")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
    number, has_pipeline, known = run.stdout.split()
    assert int(number) > 80 and (has_pipeline, known) == ("False", "True")
