"""Every query runs, and agrees with its DuckDB SQL over the same tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from marlstone.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(pdf, columns):
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return int(v) if isinstance(v, float) and v == int(v) else v.item() if hasattr(v, "item") else v

    rows = pdf[columns].astype(object).itertuples(index=False, name=None)
    return sorted(repr(tuple(map(plain, r))).replace("NaT", "None") for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLES:
        assert len(got) > 0
        return
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert canonical(got, columns) == canonical(want, columns)


def test_contract(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0


def _without(tmp_path, code, *more):
    """Runs code in a copy of the library without the training-data subpackage."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__spark_entry__.__file__).parent
    shutil.copytree(here / "marlstone", tmp_path / "marlstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *more):
        shutil.copy(here / name, tmp_path)
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}).returncode


CORE_ONLY = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"


def test_without_the_training_data_subpackage(tmp_path):
    assert _without(tmp_path, CORE_ONLY) == 0


def test_with_a_pipeline_file_but_no_subpackage(tmp_path):
    (tmp_path / "corpus_pipeline.py").write_text("from marlstone.llm import nothing")
    assert _without(tmp_path, CORE_ONLY) == 0


def test_a_broken_subpackage_is_no_absent_one(tmp_path):
    code = "import os; os.makedirs('marlstone/llm'); open('marlstone/llm/__init__.py', 'w').close(); open('marlstone/llm/catalog.py', 'w').write('import no_such_module'); import __spark_entry__"
    assert _without(tmp_path, code) != 0
