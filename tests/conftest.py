import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from answerloom.session import local_session

    session = local_session(4, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def column(spark):
    """Apply a column function to plain texts and collect the results in order."""
    from pyspark.sql import functions as F

    def run(function, values, schema="string"):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, v {schema}")
        return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]

    return run
