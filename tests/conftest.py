import tempfile

import pytest
from pyspark.sql import SparkSession


def make_session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .appName("foldmeter-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="foldmeter-test-"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


@pytest.fixture(scope="session")
def spark():
    return make_session()
