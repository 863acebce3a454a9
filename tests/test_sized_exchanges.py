"""Tasks of an exchange follow the bytes read, so that one task's memory does not grow with the table."""

from __future__ import annotations

import pytest

from airlume import session
from airlume.operators.ordering import rank_rows
from airlume.plans.catalog import ORACLES, QUERIES
from airlume.session import materialize, shuffle_width
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(session, "TASK_BYTES", 1_000, raising=False)


def test_blocks_follow_the_bytes_read(spark, small_tasks):
    rows = materialize(spark.range(3000).selectExpr("id", "(id * 7919) % 3001 v"), "rows")
    ranked = rank_rows(rows, ["v"], rank="rn")
    blocks = [f for f in ranked.inputFiles() if "/blocks-" in f]
    assert len(blocks) > 2 * shuffle_width(spark)
    assert [x.rn for x in ranked.orderBy("v").select("rn").collect()] == list(range(1, 3001))


@pytest.mark.parametrize("name, size", [("order_by_index", 50_000), ("mixture_of_experts", 2_000), ("oof_report", 8_000)])
def test_sized_exchanges_give_the_same_rows(spark, monkeypatch, name, size):
    monkeypatch.setattr(session, "TASK_BYTES", size, raising=False)
    df = QUERIES[name](spark, SF)
    want = connect(SF).execute(ORACLES[name]).df()
    got = df.toPandas()
    if name == "order_by_index":
        assert df.rdd.getNumPartitions() > shuffle_width(spark)
        assert (got[["sample_id", "cell_idx"]].to_numpy() == want[["sample_id", "cell_idx"]].to_numpy()).all()
    assert compare(got, want) == ""


def test_rows_without_files_leave_the_width_to_the_session(spark):
    assert session.sized_width(spark.createDataFrame([(1,)], "a int")) is None
