from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orderscope.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[*]", app_name="orderscope-tests", shuffle_partitions=8)
    yield session
    session.stop()


@pytest.fixture()
def tmp_dir(tmp_path):
    return str(tmp_path)
