import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture
def vectors_of(spark):
    """Make an embedding table from a matrix."""

    def make(matrix, words=None, ids=None, partitions=3):
        ids = range(len(matrix)) if ids is None else ids
        rows = [
            (int(i), words[k] if words else f"w{i}", [float(x) for x in row])
            for k, (i, row) in enumerate(zip(ids, matrix))
        ]
        schema = "idx bigint, word string, vec array<double>"
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return make


@pytest.fixture
def rng():
    return np.random.default_rng(7)


@pytest.fixture(params=["broadcast", "grid"])
def route(request, spark):
    """Run the test once per physical route of the pair scan."""
    if request.param == "grid":
        spark.conf.set("spark.xspace.broadcastBytes", "700")
    yield request.param
    spark.conf.unset("spark.xspace.broadcastBytes")
