import pytest

from gaugeworks import catalog

from oracle import connect, same


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees_with_sql(spark, small, con, name):
    same(catalog.QUERIES[name](spark, small), con, catalog.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_the_text_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "gaugeworks", tmp_path / "gaugeworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    own = {k: v for k, v in os.environ.items() if not k.startswith("PYTEST")}
    own["PYTHONPATH"] = os.pathsep.join(p for p in own.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != root)
    code = "import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') and q[2].isdigit() for q in e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=own, check=True)
    # the other tests don't need them either: all are found, and those of the functions pass
    shutil.copytree(root / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "pytest.ini", tmp_path)
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, env=own, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_geometry.py", "tests/test_operators.py"], cwd=tmp_path, env=own, check=True)


def test_a_missing_package_is_not_taken_for_missing_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "gaugeworks", tmp_path / "gaugeworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_package_that_nobody_has")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert done.returncode and "a_package_that_nobody_has" in done.stderr
