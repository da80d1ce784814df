from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from linecite.session import configure, ship_code


def make_session() -> SparkSession:
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("linecite-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship_code(session, "linecite", "workload")
    return session


@pytest.fixture(scope="session")
def spark():
    return make_session()
