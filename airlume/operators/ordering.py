"""Global ranks, running totals, exact quantiles and seeded shuffles.

None of these puts a whole group into one task. Rows are laid out in sorted
blocks over the cluster, every block is summarised, the short summary is
accumulated, and each row then only needs its place inside its block plus the
total of the earlier blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlume.session import materialize, sized_width

# monotonically_increasing_id packs the partition number above bit 33.
_POSITION_BITS = 33


def _blocked(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], width: int | None = None
) -> DataFrame:
    """Range-partition by (group, order) and keep block number and position.

    ``width``: the number of blocks, by default that of the session's shuffles.

    The layout is written out because the sampled range bounds would differ
    between two evaluations of the same plan.
    """
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    laid_out = (
        (df.repartitionByRange(width, *keys) if width else df.repartitionByRange(*keys))
        .sortWithinPartitions(*keys)
        .withColumn("_layout_row", F.monotonically_increasing_id())
    )
    return (
        materialize(laid_out, "blocks")
        .withColumn("_block", F.shiftright("_layout_row", _POSITION_BITS))
        .withColumn("_pos", F.col("_layout_row").bitwiseAND((1 << _POSITION_BITS) - 1))
        .drop("_layout_row")
    )


def _earlier_blocks(blocks: DataFrame, group: Sequence[str], weight: Column) -> DataFrame:
    """Per (group, block): weight of earlier blocks and of the whole group.

    At most one row per block and group boundary, so the window below never
    holds more rows of one group than there are blocks.
    """
    over = list(group) or [F.lit(0)]
    earlier = Window.partitionBy(*over).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    summary = blocks.groupBy(*group, "_block").agg(
        F.min("_pos").alias("_first"), weight.alias("_weight")
    )
    return materialize(
        summary.select(
            *group,
            "_block",
            "_first",
            F.coalesce(F.sum("_weight").over(earlier), F.lit(0)).cast("long").alias("_before"),
            F.sum("_weight").over(Window.partitionBy(*over)).cast("long").alias("_total"),
        ),
        "block-totals",
    )


def rank_rows(
    df: DataFrame,
    order: Sequence[Column | str],
    group: Sequence[str] = (),
    rank: str = "rn",
    total: str | None = None,
    times: int = 1,
) -> DataFrame:
    """Add the 1-based row number in ``order`` (and the group size).

    ``order`` should end in a unique key: ties then have one order only, and a
    value that fills a third of the table is still split over many blocks.
    Blocks follow the bytes read; ``times`` says how many rows are made of each row read.
    """
    blocks = _blocked(df, group, order, sized_width(df, times))
    before = _earlier_blocks(blocks, group, F.count(F.lit(1)))
    # A missing group value is a group like any other.
    before = before.withColumnsRenamed({g: f"_of_{g}" for g in group}).withColumnRenamed("_block", "_in")
    same = F.col("_block") == F.col("_in")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    out = blocks.join(before, same)
    columns = [F.col(c) for c in df.columns]
    columns.append((F.col("_before") + F.col("_pos") - F.col("_first") + 1).alias(rank))
    if total:
        columns.append(F.col("_total").alias(total))
    return out.select(*columns)


def distribution(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value with the index range it fills when sorted.

    Columns: group, value, ``cnt``, ``lo`` and ``hi`` (0-based first and last
    index) and the group size ``n``. Counting first means repeated values are
    combined before anything is shuffled or ranked.
    """
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("cnt"))
    )
    blocks = _blocked(counts, group, [value])
    before = _earlier_blocks(blocks, group, F.sum("cnt"))
    inside = (
        Window.partitionBy(*group, "_block")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    hi = F.col("_before") + F.sum("cnt").over(inside) - 1
    return (
        blocks.join(before, [*group, "_block"])
        .withColumn("hi", hi)
        .select(*group, value, "cnt", (F.col("hi") - F.col("cnt") + 1).alias("lo"), "hi",
                F.col("_total").alias("n"))
    )


def quantiles(
    dist: DataFrame, value: str, probabilities: Mapping[str, float], group: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated quantiles from a ``distribution`` table."""
    picks, results = [F.max("n").alias("n")], []
    v, lo, hi, n = F.col(value), F.col("lo"), F.col("hi"), F.col("n")
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (n - 1)
        left = F.floor(position)
        right = F.least(left + 1, n - 1)
        picks.append(F.max(F.when((lo <= left) & (left <= hi), v)).alias(f"_l_{name}"))
        picks.append(F.max(F.when((lo <= right) & (right <= hi), v)).alias(f"_r_{name}"))
        share = position - left
        results.append(
            (F.col(f"_l_{name}") + (F.col(f"_r_{name}") - F.col(f"_l_{name}")) * share).alias(name)
        )
    return dist.groupBy(*group).agg(*picks).select(*group, "n", *results)


def discrete_quantiles(
    dist: DataFrame, value: str, probabilities: Mapping[str, float], group: Sequence[str] = ()
) -> DataFrame:
    """Smallest value whose empirical CDF reaches each probability."""
    reached = (F.col("hi") + 1) / F.col("n")
    return dist.groupBy(*group).agg(
        *[F.min(F.when(reached >= p, F.col(value))).alias(name) for name, p in probabilities.items()]
    )


def shuffle_rank(
    df: DataFrame,
    key: str,
    seed: int,
    group: Sequence[str] = (),
    rank: str = "rn",
    total: str | None = None,
    times: int = 1,
) -> DataFrame:
    """Row number in a reproducible random order: md5 of seed, group and key.

    The order is the same on every engine; blocks follow the number of rows.
    """
    parts = [F.lit(str(seed)), *[F.col(g).cast("string") for g in group], F.col(key).cast("string")]
    tagged = df.withColumn("_digest", F.md5(F.concat_ws("-", *parts).cast("binary")))
    return rank_rows(tagged, ["_digest", key], group, rank, total, times).drop("_digest")
