import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from timeweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "8"), memory="8g")
    yield session
    session.stop()


@pytest.fixture(params=[None, "3"], ids=["plain", "blocks"])
def blocks(request, spark):
    """Run a test with plain windows and with blocks of three rows."""
    from timeweave.ordered import ROWS_SETTING

    if request.param:
        spark.conf.set(ROWS_SETTING, request.param)
    yield request.param
    spark.conf.unset(ROWS_SETTING)
