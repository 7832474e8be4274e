import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from marginalia.scale import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
