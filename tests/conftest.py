import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from marketflow.session import get_session

    session = get_session(
        "tests",
        master="local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def split_groups(spark):
    """Force the block path: groups above 20 rows count as too large for one task."""
    spark.conf.set("spark.marketflow.maxGroupRows", "20")
    yield
    spark.conf.unset("spark.marketflow.maxGroupRows")
