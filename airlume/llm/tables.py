"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters of `[\x20\x09-\x0D]`: fixed values.
SPACES = " \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Catalyst gives tables whose size it can't know one beyond this.
_UNKNOWN_BYTES = 1 << 55


def text_bytes(docs: DataFrame) -> int:
    """Size of the files ``docs`` reads, as Catalyst knows it; else of its texts, counted."""
    known = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if known < _UNKNOWN_BYTES:
        return known
    return docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
