import os
import sys
from pathlib import Path

import pytest

TOP = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, TOP)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (TOP, os.environ.get("PYTHONPATH")) if x)
os.environ["PYSPARK_PYTHON"] = sys.executable

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def data():
    return DATA
