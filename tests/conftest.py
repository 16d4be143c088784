from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from texelmill.session import local_session

    s = local_session(8, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
