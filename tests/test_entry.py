"""The driver contract."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry_module

ROOT = os.path.dirname(os.path.abspath(entry_module.__file__))


def test_registry_is_consistent():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    own = {name for name in queries if not name.startswith("op") and name != "pipeline"}
    assert own - set(sql) == {"rank_correlations"}


def test_flagship(spark):
    df = entry_module.entry(spark)
    assert "abort_rate" in df.columns and df.count() > 0


def test_labels(spark):
    from trialsift.functions.exprs import label_of
    from trialsift.functions.registry import CASE_LABELS

    rows = spark.range(-1, 5).select(label_of("id", {k: v for k, v in CASE_LABELS.items()}).alias("t"))
    assert [r.t for r in rows.collect()] == [*CASE_LABELS.values(), None]


def test_imports_without_the_document_operators(tmp_path):
    """A copy without the optional package, with and without the pipeline's own file."""
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "*.txt")
    shutil.copytree(ROOT, copy, ignore=skip)
    ask = "import __spark_entry__ as e; print(*e.queries())"
    for absent in (None, "corpus_pipeline.py"):
        if absent and (copy / absent).exists():
            os.remove(copy / absent)
        done = subprocess.run(
            [sys.executable, "-B", "-c", ask], cwd=copy, capture_output=True, text=True, timeout=120
        )
        assert done.returncode == 0, done.stderr[-2000:]
        names = done.stdout.split()
        assert len(names) > 100 and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
