import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bench import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session(4)


@pytest.fixture
def hours(spark):
    """``hours([(station, hour number, pm25), ...])`` → hourly rows."""
    def make(rows, value="pm25"):
        start = datetime(2024, 1, 1)
        return spark.createDataFrame(
            [(s, start + timedelta(hours=h), v) for s, h, v in rows],
            f"station string, timestamp timestamp, {value} double")
    return make


@pytest.fixture
def column(spark):
    """Evaluate a column expression over a list of values of ``x``."""
    def evaluate(expression, values, kind="double"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [r[1] for r in df.select("i", expression).orderBy("i").collect()]
    return evaluate
