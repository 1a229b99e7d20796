from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tidemill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", partitions=4, memory="6g")
    yield session
    session.stop()
