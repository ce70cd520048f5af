import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skein.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = ship(local_session(4, partitions=4, memory="4g"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
