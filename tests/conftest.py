import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparkvec.session import forget, get_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    forget(s)
    s.stop()
