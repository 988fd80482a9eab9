"""Every query with an oracle gives exactly the oracle's rows."""

from __future__ import annotations

import pytest

from barline.plans import ORACLES, QUERIES
from tests.compare import DATA, connect, difference

BASE = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(BASE)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert difference(con, QUERIES[name](spark, BASE), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, BASE).count() > 0
