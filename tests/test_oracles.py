"""Every query against its oracle SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import oracle
import pytest

from gristmill.plans import registry

SF = "/root/testdata/sf0.001"
#: No row of the tables holds what these look for; other tests give them rows.
EMPTY = {"document_secret_lines", "mean_crap_drift"}
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    found = oracle.differences(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])
    assert found in (("", "no rows") if name in EMPTY else ("",))
