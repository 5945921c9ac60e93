import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panel_data import BAR_COLUMNS, UNIVERSE_COLUMNS, bar_rows, universe_rows, weekdays  # noqa: E402

from factorloom.functions.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture
def panel(spark):
    """Two securities over 90 weekdays."""
    days = weekdays(90)
    bars = bar_rows("a", days) + bar_rows("b", days, lambda i: 50.0 + (i * 7) % 13)
    grid = universe_rows("a", days) + universe_rows("b", days)
    return (
        spark.createDataFrame(bars, BAR_COLUMNS),
        spark.createDataFrame(grid, UNIVERSE_COLUMNS),
        days,
    )
