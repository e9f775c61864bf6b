"""The entry module, with and without the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder: str) -> list[str]:
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print('NAMES', *q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=120, check=False)
    assert out.returncode == 0, out.stderr
    return out.stdout.rpartition("NAMES ")[2].split()


def copy(to: str) -> None:
    os.makedirs(to)
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), to)
    shutil.copytree(os.path.join(ROOT, "factloom"), os.path.join(to, "factloom"), ignore=shutil.ignore_patterns("llm", "__pycache__"))


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    copy(str(tmp_path / "repo"))
    found = names(str(tmp_path / "repo"))
    assert "number_support_run" in found and "pipeline" not in found and not any(n.startswith("op1_") for n in found)


def test_an_error_inside_them_is_not_taken_for_absence(tmp_path):
    folder = str(tmp_path / "repo")
    copy(folder)
    os.makedirs(f"{folder}/factloom/llm")
    for path, text in (("factloom/llm/__init__.py", ""), ("factloom/llm/queries.py", "QUERIES = ORACLE_SQL = {}"), ("corpus_pipeline.py", "import nowhere_to_be_found")):
        with open(f"{folder}/{path}", "w", encoding="utf-8") as f:
            f.write(text)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=folder, capture_output=True, text=True, timeout=120, check=False)
    assert out.returncode and "nowhere_to_be_found" in out.stderr


def test_workers_elsewhere_get_the_package(tmp_path):
    """From another folder, without a search path: a query that runs Python on workers."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "import __spark_entry__ as e\n"
        "import os; os.environ.pop('PYTHONPATH')\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "def named(batches):\n"
        "    import factloom.functions.text as t\n"
        "    for b in batches:\n"
        "        yield b\n"
        "e.catalog.QUERIES['probe'] = lambda spark, folder: spark.range(3).mapInArrow(named, 'id long')\n"
        "print('ROWS', e.queries()['probe'](spark, '').count())\n"
    )
    copy(str(tmp_path / "repo"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    os.makedirs(tmp_path / "elsewhere")
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path / "repo")], cwd=str(tmp_path / "elsewhere"), env=env, capture_output=True, text=True, timeout=200, check=False)
    assert "ROWS 3" in out.stdout, out.stderr[-2000:]
