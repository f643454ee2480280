"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

from __spark_entry__ import entry
from cradlemart.plans.oracle import ORACLE
from cradlemart.plans.queries import QUERIES

from .compare import difference, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, con, name):
    assert difference(spark, con, name, SF)[1] == ""


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0
