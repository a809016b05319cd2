"""Every registered query with SQL gives the SQL's rows on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from notegrid import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if pd.api.types.is_float_dtype(df[k]):
            df[k] = df[k].map(lambda v: repr(float(v) + 0.0))
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, duck, name):
    got, want = plain(plans.QUERIES[name](spark, SF).toPandas()), plain(duck.execute(plans.SQL[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want)


def test_entry_works_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(top, "notegrid"), tmp_path / "notegrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(top, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 25 and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
