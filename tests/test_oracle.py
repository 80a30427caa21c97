"""Every registered query against its SQL check on the smallest tables."""

import pytest
from oracle import DATA, compare, duck

from __spark_entry__ import entry
from edgeloom.plans.catalog import ORACLE, QUERIES

SF_DIR = f"{DATA}/sf0.001"
# The sample tables hold no case for these at this size; they are compared all the same.
MAY_BE_EMPTY = {"document_findings", "finding_snippets"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).count() == 12


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = compare(QUERIES[name](spark, SF_DIR), con, ORACLE[name])
    assert result is None or (result == "EMPTY" and name in MAY_BE_EMPTY), result
