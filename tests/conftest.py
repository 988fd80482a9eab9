from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from barline.session import get_session

    session = get_session("tests", cores=8)
    session.sparkContext.setLogLevel("ERROR")
    return session
