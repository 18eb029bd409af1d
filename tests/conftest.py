import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def peptide(number: int, length: int = 9) -> str:
    """Reproducible peptide text."""
    letters, state, out = "ACDEFGHIKLMNPQRSTVWY", number * 2654435761 % 2**32, []
    for _ in range(length):
        state = (state * 1103515245 + 12345) % 2**31
        out.append(letters[(state >> 8) % 20])
    return "".join(out)
