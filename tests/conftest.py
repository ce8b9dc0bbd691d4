import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))

from txloom.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]").appName("tests")
    builder = builder.config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    session = configure(builder.config("spark.driver.memory", "8g")).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tx_of(spark):
    """Transactions from a list of event maps, numbered from 1."""

    def make(*maps):
        rows = [(i + 1, m) for i, m in enumerate(maps)]
        return spark.createDataFrame(rows, "tx_id long, events map<string,array<string>>")

    return make
