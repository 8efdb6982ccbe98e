import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    builder = SparkSession.builder.master("local[4]").appName("listforge-tests")
    for k, v in {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{shared}"}.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def settings():
    from listforge.config import Settings

    return Settings(today=date(2026, 6, 15))


@pytest.fixture
def column(spark):
    """Values of one column expression over rows of one text column x."""

    def of(expression, rows):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
        return [r[1] for r in df.select("i", expression).orderBy("i").collect()]

    return of
