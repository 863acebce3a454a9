"""Row cleaning, missing-value repair, binning and other row-level operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlume.operators.ordering import rank_rows
from airlume.operators.skew import salted_join
from airlume.session import materialize

# Markers used for "no data" in altitude rasters; defaults per attribute.
NODATA_MARKERS = (-9999.0, -32767.0, -32768.0)
DEFAULT_HEIGHT = 0.0
DEFAULT_LANDUSE = 20

# Accepted column names, best first.
LON_ALIASES = ("longitude", "lon", "lng", "x")
LAT_ALIASES = ("latitude", "lat", "y")
AREA_LON_ALIASES = ("longitude", "lon", "x")
DISTANCE_ALIASES = ("disbtwtxrx", "distance")

# Rows per block when a dense row index is scanned in order.
BLOCK_ROWS = 1_000_000


def pick_column(columns: Sequence[str], aliases: Sequence[str]) -> str:
    """First alias, in alias order, that names a column in any case."""
    by_lower = {c.lower(): c for c in columns}
    for alias in aliases:
        if alias in by_lower:
            return by_lower[alias]
    raise KeyError(f"none of {list(aliases)} among {list(columns)}")


def resolve_columns(df: DataFrame, area: bool = False) -> DataFrame:
    """Rename the coordinate columns to longitude and latitude.

    With ``area`` the distance column is resolved too and ``lng`` is not known.
    Only names change, so nothing is read or moved.
    """
    wanted = {
        pick_column(df.columns, AREA_LON_ALIASES if area else LON_ALIASES): "longitude",
        pick_column(df.columns, LAT_ALIASES): "latitude",
    }
    if area:
        wanted[pick_column(df.columns, DISTANCE_ALIASES)] = "distance_m"
    return df.select([F.col(c).alias(wanted.get(c, c)) for c in df.columns])


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def dedupe_measurements(
    df: DataFrame, columns: Sequence[str], lone_source_quirk: bool = False, n_sources: int = 2
) -> DataFrame:
    """Distinct rows of ``columns``.

    ``lone_source_quirk`` keeps the repeats when only one source was read.
    """
    rows = df.select(*columns)
    return rows if lone_source_quirk and n_sources < 2 else rows.dropDuplicates()


def nodata_to_null(df: DataFrame, column: str, markers: Sequence[float] = NODATA_MARKERS) -> DataFrame:
    c = F.col(column)
    return df.withColumn(column, F.when(~c.isin(*markers), c))


def fill_area_mean(
    df: DataFrame, column: str, group: Sequence[str], last_resort: float | None = 0.0
) -> DataFrame:
    """Missing values become the mean of their group, then ``last_resort``.

    The mean is a partial aggregate plus a join on the few group keys, so a
    group holding most of the rows is never gathered in one place.
    """
    means = materialize(df.groupBy(*group).agg(F.avg(column).alias("_mean")), "means")
    joined = salted_join(df, means, list(group), "left")
    filled = F.coalesce(F.col(column), F.col("_mean"))
    if last_resort is not None:
        filled = F.coalesce(filled, F.lit(last_resort))
    return joined.withColumn(column, filled).select(*df.columns)


def fill_default(df: DataFrame, height: str | None = None, landuse: str | None = None,
                 landuse_default: int = DEFAULT_LANDUSE) -> DataFrame:
    """Building height 0.0 and an integer land-use code where nothing matched."""
    if height:
        df = df.withColumn(height, F.coalesce(F.col(height), F.lit(DEFAULT_HEIGHT)))
    if landuse:
        df = df.withColumn(landuse, F.coalesce(F.col(landuse), F.lit(landuse_default)).cast("int"))
    return df


def _blocks(group: Sequence[str], index: str, block_rows: int) -> tuple[Column, list[str]]:
    return F.floor(F.col(index) / block_rows), [*group, "_block"]


def _edge_values(
    df: DataFrame, column: str, group: Sequence[str], index: str, forward: bool
) -> DataFrame:
    """Per block: the nearest known value (and its index) in the blocks before or after."""
    known = F.when(F.col(column).isNotNull(), F.struct(F.col(index).alias("i"), F.col(column).alias("v")))
    name = "_prev" if forward else "_next"
    per_block = df.groupBy(*group, "_block").agg((F.max if forward else F.min)(known).alias("_edge"))
    # Looking ahead is looking back in reverse order: that frame grows row by row,
    # while an open-ended frame ahead would be scanned anew for every row.
    order = F.asc("_block") if forward else F.desc("_block")
    over = Window.partitionBy(*(group or [F.lit(0)])).orderBy(order)
    reach = F.last("_edge", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    return per_block.select(*group, "_block", reach.alias(name))


def _carried(edges: DataFrame, keys: Sequence[str], side: str) -> tuple[DataFrame, Column]:
    """``edges`` and the condition to bring them to their blocks; a missing group is a group."""
    renamed = edges.withColumnsRenamed({k: f"_{side}_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{side}_{k}"))
    return renamed, same


def forward_fill(
    df: DataFrame, column: str, group: Sequence[str], index: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Missing values repeat the last known one in ``index`` order.

    ``index`` is an integer unique in its group, so a block of the index holds
    at most ``block_rows`` rows; only one value per block crosses blocks.
    """
    block, keys = _blocks(group, index, block_rows)
    blocked = df.withColumn("_block", block)
    carried = _edge_values(blocked, column, group, index, forward=True)
    inside = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    near = F.last(F.col(column), ignorenulls=True).over(inside)
    return (
        blocked.withColumn("_near", near)
        .join(*_carried(carried, keys, "prev"), "left")
        .withColumn(column, F.coalesce("_near", "_prev.v"))
        .select(*df.columns)
    )


def interpolate_linear(
    df: DataFrame, column: str, group: Sequence[str], index: str, position: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Missing values by straight line between the known neighbours.

    Distance is measured in ``position``, an integer column in the order of the
    index; by default it is the place of a row in its group, whatever gaps the
    index has. Leading gaps stay missing, trailing gaps repeat the last known value.
    """
    if position is None:
        placed = rank_rows(df, [index], group, "_position", "_of")
        out = interpolate_linear(placed, column, group, "_position", "_position", block_rows)
        return out.select(*df.columns)
    block, keys = _blocks(group, index, block_rows)
    blocked = df.withColumn("_block", block)
    c = F.col(column)
    known = F.when(c.isNotNull(), F.struct(F.col(position).alias("i"), c.alias("v")))
    block_of = Window.partitionBy(*keys)
    nearest = F.last(known, ignorenulls=True)
    before = nearest.over(block_of.orderBy(F.asc(index)).rowsBetween(Window.unboundedPreceding, 0))
    after = nearest.over(block_of.orderBy(F.desc(index)).rowsBetween(Window.unboundedPreceding, 0))
    left = _edge_values(blocked, column, group, position, forward=True)
    right = _edge_values(blocked, column, group, position, forward=False)
    a, b = F.col("_a"), F.col("_b")
    share = (F.col(position) - a["i"]) / (b["i"] - a["i"])
    value = (
        F.when(c.isNotNull(), c)
        .when(a.isNull(), F.lit(None))
        .when(b.isNull(), a["v"])
        .otherwise(a["v"] + (b["v"] - a["v"]) * share)
    )
    return (
        blocked.withColumn("_before", before)
        .withColumn("_after", after)
        .join(*_carried(left, keys, "prev"), "left")
        .join(*_carried(right, keys, "next"), "left")
        .withColumn("_a", F.coalesce("_before", "_prev"))
        .withColumn("_b", F.coalesce("_after", "_next"))
        .withColumn(column, value)
        .select(*df.columns)
    )


def merge_height(
    altitudes: DataFrame, heights: DataFrame, group: Sequence[str], index: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Terrain plus building height, row by row; both inputs must hold the same rows."""
    n_altitudes, n_heights = altitudes.count(), heights.count()
    if n_altitudes != n_heights:
        raise ValueError(f"row counts differ: {n_altitudes} altitudes, {n_heights} heights")
    filled = interpolate_linear(altitudes, "dn", group, index, block_rows=block_rows)
    height = heights.select(*group, index, F.coalesce("measured_height", F.lit(0.0)).alias("_h"))
    return filled.join(height, [*group, index]).withColumn("dn", F.col("dn") + F.col("_h")).drop("_h")


def broadcast_group_max(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Every row gets the largest value seen at its position."""
    highest = df.groupBy(*keys).agg(F.max(column).alias("_max"))
    return (
        salted_join(df, highest, list(keys), "left").withColumn(column, F.col("_max")).select(*df.columns)
    )


def select_channels(df: DataFrame, channels: Sequence[str], mask: Sequence[int]) -> DataFrame:
    """Drop the feature channels whose mask bit is 0."""
    dropped = {c for c, bit in zip(channels, mask, strict=True) if not bit}
    return df.select(*[c for c in df.columns if c not in dropped])


def bin_edges(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """One row with the range of every column to be cut into equal-width bins."""
    picks = []
    for c in columns:
        picks += [F.min(c).alias(f"_{c}_lo"), F.max(c).alias(f"_{c}_hi")]
    return df.agg(*picks)


def equal_width_bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Right-closed bin 0..bins-1 of [lo, hi], NULL outside.

    The first edge is lowered by 0.1 % of the range, so the minimum is inside.
    When all values are equal the range is widened by 0.1 % to both sides.
    """
    flat = lo == hi
    pad = F.when(lo != 0, 0.001 * F.abs(lo)).otherwise(F.lit(0.001))
    low, high = F.when(flat, lo - pad).otherwise(lo), F.when(flat, hi + pad).otherwise(hi)
    width = (high - low) / bins
    raw = F.greatest(F.ceil((value - low) / width) - 1, F.lit(0))
    below = F.when(flat, low).otherwise(low - 0.001 * (high - low))
    return F.when((value >= below) & (value <= high), F.least(raw, F.lit(bins - 1)).cast("int"))


def with_bins(df: DataFrame, edges: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Add ``<column>_bin`` using edges taken from the training rows (one row)."""
    lo_hi = edges.first()
    for c, bins in columns.items():
        lo, hi = F.lit(lo_hi[f"_{c}_lo"]), F.lit(lo_hi[f"_{c}_hi"])
        df = df.withColumn(f"{c}_bin", equal_width_bin(F.col(c), lo, hi, bins))
    return df


def input_counts(raw: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Rows merged, rows dropped for a missing value and cells that were missing."""
    missing = [F.col(c).isNull() for c in columns]
    any_missing = missing[0]
    cells = missing[0].cast("int")
    for m in missing[1:]:
        any_missing, cells = any_missing | m, cells + m.cast("int")
    return raw.groupBy(*group).agg(
        F.count_if(~any_missing).alias("rows_merged"),
        F.count_if(any_missing).alias("rows_dropped"),
        F.sum(cells).alias("cells_missing"),
    )
