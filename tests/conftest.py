import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from sentiloom.session import local_session

    session = local_session("sentiloom-tests", cores=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate one expression over one row."""
    from pyspark.sql import functions as F

    def run(expression, **values):
        literals = [
            (F.lit(None) if v is None else F.array(*[F.lit(x) for x in v]).cast("array<int>") if isinstance(v, list) else F.lit(v)).alias(k)
            for k, v in values.items()
        ]
        df = spark.range(1).select(F.col("id"), *literals)
        return df.select(expression.alias("x")).first()["x"]

    return run
