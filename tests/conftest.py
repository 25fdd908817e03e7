import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stratalith.session import get_session, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = tune(get_session("tests", "8", spark__sql__shuffle__partitions="8"))
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
