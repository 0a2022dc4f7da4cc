"""Every query against its SQL on the smallest tables; see run_oracle.py for others."""

import pytest

import __spark_entry__ as contract
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(compiled, duck, name):
    frame = contract.queries()[name](compiled, FOLDER)
    assert compare(frame, duck, contract.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_without_sql_has_rows(compiled, name):
    assert contract.queries()[name](compiled, FOLDER).count() > 0


def test_entry(compiled):
    assert contract.entry(compiled).count() > 0
