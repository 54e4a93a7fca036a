import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    builder = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "2")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
               .config("spark.sql.session.timeZone", "UTC"))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def rows(spark):
    """rows("a string, b int", (..), (..)) -> DataFrame"""
    def make(schema, *data):
        return spark.createDataFrame([tuple(d) for d in data], schema)
    return make


def as_set(df, *columns):
    return {tuple(r) if len(columns) != 1 else r[0] for r in df.select(*columns).collect()}
