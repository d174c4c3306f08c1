import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tuneframe.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, app="tuneframe-tests", driver_memory="4g")
    yield s
    s.stop()


@pytest.fixture()
def workdir(tmp_path):
    return tmp_path
