import os
import sys

import pytest

sys.path.insert(0, os.path.abspath(os.path.join(os.path.dirname(__file__), "..")))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from chalkline.session import local_session
    s = local_session(cores=8, shuffle_partitions=8, app="chalkline-tests")
    yield s
    s.stop()


def one_col(spark, values, expr_fn, schema="x string"):
    """Apply a Column function to a one-column frame and return results in order."""
    from pyspark.sql import functions as F
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    out = df.select("i", expr_fn(F.col(schema.split()[0])).alias("y")).orderBy("i").collect()
    return [r["y"] for r in out]
