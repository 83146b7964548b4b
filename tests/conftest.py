import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corvane.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, "4g")


@pytest.fixture
def folder():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL


def day(n: int, hour: int = 0, second: int = 0) -> datetime:
    return datetime(2022, 1, n, hour, 0, second)
