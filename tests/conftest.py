import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lorekeep.session import build_session  # noqa: E402
from lorekeep.sources.catalog import SampleCatalog  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample(spark):
    return SampleCatalog(spark, SF_DIR)


@pytest.fixture
def values(spark):
    """Evaluate a column function on a list of texts, in order."""
    from pyspark.sql import functions as F

    def run(function, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").coalesce(1)
        return [row[0] for row in df.orderBy("i").select(function(F.col("x"))).collect()]

    return run
