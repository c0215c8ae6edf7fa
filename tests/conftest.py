import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quern.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # plans are small and many: the quick compiler of the JVM alone, and few tasks
    s = local_session(4, memory="4g", shuffle_partitions=2, app="tests", extra={"spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1", "spark.sql.parquet.compression.codec": "uncompressed"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of named values."""

    def value(expr, **row):
        from pyspark.sql import functions as F

        df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in row.items())) if row else spark.range(1)
        return df.select(expr.alias("x")).first()[0]

    return value
