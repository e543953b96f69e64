import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


#: The known results need two public tables that are not in the repository; GOLDEN_DATA names the folder that holds them.
collect_ignore = [] if os.environ.get("GOLDEN_DATA") else ["test_golden.py"]


def _golden(kind: str) -> str:
    return str(sorted(Path(os.environ["GOLDEN_DATA"]).rglob(f"*.{kind}"))[0])


@pytest.fixture(scope="session")
def credit(spark):
    from sublode import read_arff

    return read_arff(spark, _golden("arff")).repartition(2).cache()


@pytest.fixture(scope="session")
def titanic(spark):
    from sublode import read_tsv

    return read_tsv(spark, _golden("csv")).cache()


@pytest.fixture(scope="session")
def tables():
    return os.environ.get("TEST_TABLES", "/root/testdata/sf0.001")
