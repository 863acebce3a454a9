"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is split over several tasks.
HOT_ROWS = 1_000_000
# Any key outside the largest MAX_HOT_KEYS holds under 1/MAX_HOT_KEYS of all rows.
MAX_HOT_KEYS = 1_000
MAX_PIECES = 1_024
BROADCAST_BYTES = 10 * 1024 * 1024


def known_small(df: DataFrame) -> bool:
    """True when Catalyst's size of ``df`` is below the broadcast limit.

    Meant for scans and aggregates of written tables, whose size is the file
    size or less; expanded tables are written out before they are joined.
    """
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= BROADCAST_BYTES


def hot_keys(
    df: DataFrame, keys: Sequence[str], hot_rows: int, counts: DataFrame | None = None
) -> DataFrame | None:
    """Keys above ``hot_rows`` and the number of pieces each is split into.

    A distributed top-k: at most MAX_HOT_KEYS rows reach the driver, whatever
    the size of ``df``. Null keys never match anything and are left alone.
    ``counts`` (keys, _rows) saves the counting pass where it is known already.
    """
    if counts is None:
        counts = df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    pieces = F.least(F.ceil(F.col("_rows") / hot_rows), F.lit(MAX_PIECES)).cast("int")
    top = (
        counts.where(F.col("_rows") > hot_rows)
        .orderBy(F.desc("_rows"))
        .limit(MAX_HOT_KEYS)
        .select(*keys, pieces.alias("_pieces"))
    )
    rows = top.collect()
    return df.sparkSession.createDataFrame(rows, top.schema) if rows else None


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_rows: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join (inner or left) that spreads hot keys of ``left``.

    A ``right`` below the checked broadcast limit needs no exchange at all.
    Otherwise rows of a hot key are dealt over its pieces by a hash of the row, and the
    matching rows of ``right`` are repeated once per piece, so every pair still
    meets exactly once. Keys that are not hot take the plain path untouched.

    The merge hint keeps Catalyst from broadcasting ``left``: the size it knows
    for an expanded table is that of the rows before they were multiplied.
    """
    if hot_rows is None and known_small(right):
        return left.join(F.broadcast(right), list(on), how)
    hot = hot_keys(left, on, hot_rows or HOT_ROWS, counts)
    if hot is None:
        return left.join(right.hint("merge"), list(on), how)
    hot = F.broadcast(hot)  # at most MAX_HOT_KEYS rows
    deal = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.coalesce("_pieces", F.lit(1)))
    dealt = left.join(hot, list(on), "left").withColumn("_salt", deal.cast("int")).drop("_pieces")
    repeated = (
        right.join(hot, list(on), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)))
        .drop("_pieces")
    )
    return dealt.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")
