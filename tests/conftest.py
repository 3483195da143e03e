import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("promptledger-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """Build a payload table from texts."""

    def build(*values):
        rows = list(enumerate(values))
        return spark.createDataFrame(rows, "payload_id BIGINT, text STRING")

    return build


@pytest.fixture(scope="session")
def value_of(spark):
    """Evaluate a column for each given value of ``x``."""

    def evaluate(values, column, kind="STRING"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, x {kind}")
        rows = df.select("i", column.alias("y")).orderBy("i").collect()
        return [r.y for r in rows]

    return evaluate
