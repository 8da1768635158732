"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

ROOT = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
# empty at the smallest scale: no user is predicted as noise there
MAY_BE_EMPTY = {"posts_of_users", "posts_sample_per_user"}

QUERIES = {n: q for n, q in entry.queries().items() if n not in entry.LLM_QUERIES}  # those have tests of their own
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ok, message = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), ROOT)
    assert ok or (name in MAY_BE_EMPTY and message.startswith("n=0")), message


def test_entry(spark):
    assert entry.entry(spark).columns == ["token", "frequency", "token_id"]
