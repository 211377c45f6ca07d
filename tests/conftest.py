import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from moneytrail.session import build_session
    session = build_session("local[8]", "tests", **{
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp"),
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tx(spark, tiny):
    from moneytrail.sources import views
    return views.transactions(spark, tiny).persist()
