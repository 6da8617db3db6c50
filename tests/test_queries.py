import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from siftloom import queries as core
from tests.compare import same

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(spark, core.queries()[name], core.oracle_sql()[name], DIR)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert core.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["category", "n", "share"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_need_the_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for p in ("siftloom", "__spark_entry__.py"):
        shutil.copy(root / p, tmp_path / p) if p.endswith(".py") else shutil.copytree(root / p, tmp_path / p, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'trend' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": "/root"})
