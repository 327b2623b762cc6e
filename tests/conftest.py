import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from glosswright.session import local_session, workers_find_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "4g", 4)
    s.sparkContext.setLogLevel("ERROR")
    workers_find_package(s)
    yield s
