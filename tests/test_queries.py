import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tallyhouse.queries import ORACLE_SQL, QUERIES
from tests.oracle import FOLDER, check


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("tallyhouse/llm",), ("tallyhouse/llm", "corpus_pipeline.py")])
def test_entry_point_without_the_training_data_folder(tmp_path, gone):
    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.parquet"))
    for name in gone:
        place = copy / name
        if place.is_dir():
            shutil.rmtree(place)
        elif place.exists():
            place.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, check=True, timeout=120)
