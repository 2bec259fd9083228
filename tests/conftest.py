import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from tallyspark.schema import ENTRY  # noqa: E402
from tallyspark.session import builder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (builder("tests").master("local[4]").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def entries(spark):
    """Entries from (date, description, amount, tx_type, balance) tuples of one user."""
    def make(rows, user="u1", upload="s1"):
        return spark.createDataFrame(
            [(user, upload, i, dt.date.fromisoformat(day), text, Decimal(str(amount)), kind,
              None if balance is None else Decimal(str(balance)))
             for i, (day, text, amount, kind, balance) in enumerate(rows)], ENTRY)
    return make
