"""Every query with an SQL form equals it on whole tables; the others return rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from airlume.plans.catalog import ORACLES, QUERIES
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
# Jobs that train models several times are left to tests/oracle.py.
SLOW = {"job_train", "job_transfer", "job_transfer_incremental", "job_nearfield_finetune", "job_predict_area"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, duck.execute(ORACLES[name]).df()) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert contract.entry(spark).count() == 10
