import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from tidewatch.session import build_session

    s = build_session("tests", master="local[8]", shuffle_partitions=8)
    yield s
    s.stop()
