import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from chatloom.session import get_spark  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                 "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def evaluate(spark):
    """Values of one expression over a list of texts."""
    def run(expr, values):
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string")
        return [r[0] for r in rows.repartition(1).sortWithinPartitions("i").select(expr.alias("v")).collect()]
    return run
