import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def corpus(spark):
    def make(*bodies, ids=None):
        ids = ids or [f"d{i + 1}" for i in range(len(bodies))]
        return spark.createDataFrame(list(zip(ids, bodies)), "doc_id string, body string")

    return make


@pytest.fixture
def terms(spark):
    def make(*words, name="term"):
        return spark.createDataFrame([(w,) for w in words], f"{name} string")

    return make


def tuples(df, *columns):
    return sorted(tuple(row) for row in df.select(*(columns or df.columns)).collect())
