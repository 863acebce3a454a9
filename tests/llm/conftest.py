from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture
def texts(spark: SparkSession):
    """Table of (doc_id, text) with columns whose names might clash."""

    def make(rows: list[tuple[int | None, str | None]]) -> DataFrame:
        full = [(i, t, "x", None, 7) for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, hash string, node long, bucket int"
        )

    return make
