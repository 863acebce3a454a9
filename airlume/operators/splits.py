"""Unions, shuffles and train / validation / test splits.

Random order means order by md5(seed, key): the same on every run and engine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlume.operators.ordering import rank_rows, shuffle_rank
from airlume.session import sized_width

MAX_EXPERTS = 30
VALIDATION_SHARE = 0.2
FINE_TUNE_SHARE = 0.1
SMALL_SET = 200


def union_datasets(*datasets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, datasets)


def shuffle_rows(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Add ``position``: the place of every row in a seeded permutation."""
    return shuffle_rank(df, key, seed, rank="position")


def order_by_index(df: DataFrame, keys: Sequence[str], times: int = 1) -> DataFrame:
    """Restore receiver and cell order: sorted ranges, one after the other.

    ``times``: rows made of each row read, so that a range of expanded rows is no larger.
    """
    width = sized_width(df, times)
    return df.repartitionByRange(width, *keys).sortWithinPartitions(*keys) if width else df.orderBy(*keys)


def test_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Add ``is_test`` for the first floor(n * share) rows of the permutation.

    Apply it to original samples; flipped twins then follow their original.
    """
    ranked = shuffle_rank(df, key, seed, rank="_rn", total="_n")
    return ranked.withColumn("is_test", F.col("_rn") <= F.floor(F.col("_n") * share)).drop("_rn", "_n")


def split_with_twins(augmented: DataFrame, share: float, seed: int, mimic_leak: bool = False) -> DataFrame:
    """``is_test`` for augmented rows: a flipped twin stays with its original.

    ``mimic_leak`` splits originals and twins independently instead.
    """
    if mimic_leak:
        row = F.concat_ws("-", F.col("sample_id").cast("string"), F.col("flipped").cast("string"))
        return test_split(augmented.withColumn("_row", row), "_row", share, seed).drop("_row")
    ids = test_split(augmented.select("sample_id").distinct(), "sample_id", share, seed)
    return augmented.join(ids, "sample_id")


def expert_splits(
    train: DataFrame, key: str, k: int, seed: int, share: float = VALIDATION_SHARE
) -> DataFrame:
    """(key, expert_id, is_val): floor(share * n) validation rows drawn per expert."""
    if not 1 <= k <= MAX_EXPERTS:
        raise ValueError(f"k must be 1..{MAX_EXPERTS}")
    members = train.select(
        key, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("expert_id")
    )
    ranked = shuffle_rank(members, key, seed, ["expert_id"], "_rn", "_n", times=k)
    return ranked.withColumn("is_val", F.col("_rn") <= F.floor(F.lit(share) * F.col("_n"))).drop("_rn", "_n")


def holdout_complement(rows: DataFrame, held_out: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows that are not in the held-out draw."""
    return rows.join(held_out, list(keys), "left_anti")


def replicate_small(df: DataFrame, at_least: int = SMALL_SET) -> DataFrame:
    """Repeat a small training set ceil(at_least / n) times; ``copy`` numbers the repeats."""
    n = df.count()
    copies = math.ceil(at_least / n) if n else 1
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))


def uncertainty_split(
    df: DataFrame, mode: str, key: str = "sample_id", share: float = FINE_TUNE_SHARE, seed: int = 42
) -> DataFrame:
    """Add ``part``: the first max(1, floor(share * n)) rows are ``ft``, the rest ``test``.

    ``mode``: most uncertain first (``high``), least first (``low``) or ``random``.
    """
    if mode == "random":
        ranked = shuffle_rank(df, key, seed, rank="_rn", total="_n")
    else:
        first: Column = F.desc("uncertainty") if mode == "high" else F.asc("uncertainty")
        ranked = rank_rows(df, [first, key], (), "_rn", "_n")
    cut = F.greatest(F.floor(F.lit(share) * F.col("_n")), F.lit(1))
    return ranked.withColumn("part", F.when(F.col("_rn") <= cut, "ft").otherwise("test")).drop("_rn", "_n")


def fold_of(df: DataFrame, key: str, folds: int, seed: int) -> DataFrame:
    """Add ``fold`` 0..folds-1 by turns along the permutation."""
    return shuffle_rank(df, key, seed, rank="_rn").withColumn(
        "fold", (F.col("_rn") % folds).cast("int")
    ).drop("_rn")
