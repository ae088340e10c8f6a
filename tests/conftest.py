import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def golden(spark):
    """Six lines of two series."""
    rows = [
        (1, "web", 1000, "error in login"),
        (2, "web", 1500, "timeout on read"),
        (3, "web", 2000, "error timeout retry error"),
        (4, "db", 2000, "error on disk"),
        (5, "db", 3500, "disk ok"),
        (6, "db", 6000, "Error upper case"),
    ]
    from pyspark.sql import functions as F

    from cairnlog.sources.tables import as_logs

    df = spark.createDataFrame(rows, "id bigint, app string, ts bigint, line string")
    return as_logs(df, F.col("id"), {"app": F.col("app")}, F.col("ts"), F.col("line"))
