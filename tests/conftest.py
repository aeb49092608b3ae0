import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path


WORD = "image_id bigint, ord int, text string, avg_x double, avg_y double, left_x int, right_x int, top_y int, bottom_y int"


@pytest.fixture
def words(spark):
    """Words from (text, x, y), twenty pixels around their centre."""

    def make(*given, image_id=1):
        rows = [(image_id, i, t, float(x), float(y), int(x) - 20, int(x) + 20, int(y) - 20, int(y) + 20) for i, (t, x, y) in enumerate(given)]
        return spark.createDataFrame(rows, WORD)

    return make
