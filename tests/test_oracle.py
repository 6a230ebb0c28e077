"""Registered queries against their SQL oracle on the smallest tables, and registry sanity."""

import os

import pytest

from oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not mounted")

LARGER = "/root/testdata/sf0.01"
# Too little history on the smallest tables for any row: these are compared on the next larger ones.
EMPTY = ("ohlc_daily_complete", "st_grid_complete", "xs_eligible")


def names():
    from tidemark.workbench import ORACLES
    return list(ORACLES)


def test_every_oracle_has_a_query():
    from tidemark.workbench import ORACLES, QUERIES
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 180


@pytest.fixture(scope="module")
def connections():
    return {sf: connect(sf) for sf in (SF, LARGER)}


@pytest.mark.parametrize("name", names())
def test_oracle(spark, connections, name):
    from tidemark.workbench import ORACLES, QUERIES
    sf = LARGER if name in EMPTY else SF
    assert compare(QUERIES[name](spark, sf), connections[sf], ORACLES[name]) == ""
