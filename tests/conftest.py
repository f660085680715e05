import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
    builder = builder.config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.driver.host", "127.0.0.1")
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
