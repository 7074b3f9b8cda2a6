import pytest

from glintmill.oracles import oracle_sql
from glintmill.queries import flagship, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_is_its_sql(name, against_sql):
    against_sql(queries()[name], oracle_sql()[name])


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def test_flagship(spark, sf_dir):
    assert {r.variant for r in flagship(spark, sf_dir).collect()} == {"bm25", "dense", "hybrid"}


def test_entry_without_training_data_operators(tmp_path):
    """The entry module imports, and has the other queries, where the subpackage is gone."""
    import shutil
    import subprocess
    import sys

    from conftest import ROOT

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "glintmill", tmp_path / "glintmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(queries())), str(len(oracle_sql()))], out.stderr
