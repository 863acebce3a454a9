"""From measured points to link geometry, path cells and feature arrays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlume.functions import features as fx
from airlume.functions import geometry as geo
from airlume.functions import radio
from airlume.operators import raster, spatial
from airlume.operators.cleaning import DEFAULT_HEIGHT, fill_area_mean, nodata_to_null
from airlume.operators.skew import salted_join
from airlume.session import materialize, shuffle_width

GEOMETRY = ("x_m", "y_m", "rise_m", "distance_m", "fresnel_h", "fresnel_v",
            "cos_theta", "sin_theta", "cos_phi", "sin_phi")
CELL = ["sample_id", "cell_idx"]
ARRAYS = ("height", "slope", "landuse")


def join_site_params(points: DataFrame, sites: DataFrame) -> DataFrame:
    """Attach transmitter position, power, frequency and antenna heights."""
    return salted_join(points, sites, ["site_id"])


def sample_receivers(
    measurements: DataFrame, sites: DataFrame, buildings: DataFrame | None, pixels: DataFrame | None,
    meta: DataFrame | None, key: str = "sample_id",
) -> DataFrame:
    """Altitude of every receiver: terrain (mean of its site where unknown) plus building.

    Without a terrain layer, anywhere or at its site, the ground is at 0. Without
    a building layer every height is 0. Points at one position fall in
    the same building, so equal positions get equal heights.
    """
    if buildings is None:
        housed = measurements.withColumn("measured_height", F.lit(DEFAULT_HEIGHT))
    else:
        housed = spatial.point_in_polygon_join(
            measurements, buildings, "measured_height", DEFAULT_HEIGHT, key
        )
    if pixels is None:
        filled = housed.withColumn("dn", F.lit(0.0))
    else:
        terrain = materialize(nodata_to_null(raster.raster_point_sample(housed, pixels, meta), "dn"), "terrain")
        filled = fill_area_mean(terrain, "dn", ["site_id"])
    grounded = filled.withColumn("dn", F.col("dn") + F.col("measured_height")).drop("measured_height")
    return join_site_params(grounded, sites)


def with_link_geometry(receivers: DataFrame) -> DataFrame:
    """Local metres, rise, distance, view half widths and link angles."""
    x, y = geo.ll_to_meter(F.col("longitude"), F.col("latitude"), F.col("tx_lon"), F.col("tx_lat"))
    rise = (F.col("dn") + F.col("rx_ant_h")) - (F.col("tx_alt") + F.col("tx_ant_h"))
    placed = receivers.withColumns({"x_m": x, "y_m": y, "rise_m": rise})
    x, y, rise = F.col("x_m"), F.col("y_m"), F.col("rise_m")
    placed = placed.withColumn("distance_m", geo.link_distance(x, y, rise))
    fresnel_h, fresnel_v = geo.fresnel_radii(F.col("distance_m"))
    return placed.withColumns(
        {"fresnel_h": fresnel_h, "fresnel_v": fresnel_v, **geo.rotation_angles(x, y, rise)}
    )


def path_cells(links: DataFrame) -> DataFrame:
    """1,116 grid cells per receiver in the link plane (grid metres only)."""
    spark = links.sparkSession
    # Spread the receivers before the rows multiply; one file must not stay one task.
    spread = links.repartition(shuffle_width(spark), "sample_id")
    cells = spread.withColumn("cell_idx", F.explode(F.sequence(F.lit(0), F.lit(geo.GRID_CELLS - 1))))
    px, py = geo.path_grid_xy(F.col("cell_idx"), F.col("distance_m"), F.col("fresnel_h"))
    return cells.withColumns({"px": px, "py": py})


def grid_to_geo(cells: DataFrame) -> DataFrame:
    """Longitude and latitude of every grid cell."""
    x, y = geo.grid_to_metres(
        F.col("px"), F.col("py"), F.col("cos_theta"), F.col("sin_theta"), F.col("cos_phi")
    )
    lon, lat = geo.meter_to_ll(x, y, F.col("tx_lon"), F.col("tx_lat"))
    return cells.withColumns({"cell_lon": lon, "cell_lat": lat})


def with_footprints(cells: DataFrame) -> DataFrame:
    return cells.withColumns(
        geo.footprint_rect(F.col("cell_lon"), F.col("cell_lat"), F.col("distance_m"))
    )


def cell_height(altitude: Column, x: Column, y: Column) -> Column:
    """Height of a map point above the line of sight, in the link frame."""
    ct, st, cp, sp = (F.col(c) for c in ("cos_theta", "sin_theta", "cos_phi", "sin_phi"))
    return -sp * ct * x - sp * st * y + cp * (altitude - (F.col("tx_alt") + F.col("tx_ant_h")))


def with_cell_height(cells: DataFrame, altitude: str = "dn_cell") -> DataFrame:
    x, y = geo.ll_to_meter(F.col("cell_lon"), F.col("cell_lat"), F.col("tx_lon"), F.col("tx_lat"))
    return cells.withColumn("height", cell_height(F.col(altitude), x, y))


def assemble_features(
    cells: DataFrame, values: Sequence[str], key: str = "sample_id", combine: bool = False
) -> DataFrame:
    """One row per sample with every value as an array in cell order.

    The rows are placed by sample once; both aggregates below reuse that
    placement. ``combine`` merges several partial rows per cell by maximum.
    ``sort_array`` compares in Java; ``array_sort`` would run a lambda per comparison.
    """
    placed = cells.select(key, "cell_idx", *values).repartition(shuffle_width(cells.sparkSession), key)
    if combine:
        placed = placed.groupBy(key, "cell_idx").agg(*[F.max(v).alias(v) for v in values])
    packed = placed.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("cell_idx", *values))).alias("_cells")
    )
    return packed.select(key, *[F.col(f"_cells.{v}").alias(v) for v in values])


def sample_cells(
    links: DataFrame, buildings: DataFrame | None, pixels: DataFrame | None, meta: DataFrame | None,
    landuse: DataFrame | None,
) -> DataFrame:
    """Per sample: arrays of terrain, building height and land use along the path.

    Every sample has all its cells, whatever layers its site has.

    Each map is sampled on its own from the same cells, carrying only keys and
    one value; the partial results meet in a single exchange by sample. A
    missing land-use layer gives the background code everywhere.
    """
    cells = with_footprints(grid_to_geo(path_cells(links))).select(
        "site_id", *CELL, "rx1", "ry1", "rx2", "ry2"
    )
    none = F.lit(None).cast("double")
    no_type = F.lit(None).cast("int")
    sampled = cells.withColumn("dn", none) if pixels is None else raster.raster_window_max(cells, pixels, meta)
    terrain = sampled.select(
        *CELL, F.col("dn").alias("terrain"), none.alias("building"), no_type.alias("landuse")
    )
    parts = terrain
    if buildings is not None:
        heights = spatial.footprint_heights(cells, buildings, CELL)
        parts = parts.unionByName(
            heights.select(
                *CELL, none.alias("terrain"), F.col("measured_height").alias("building"),
                no_type.alias("landuse"),
            )
        )
    if landuse is not None:
        modes = raster.footprint_landuse_mode(cells, landuse)
        parts = parts.unionByName(
            modes.select(*CELL, none.alias("terrain"), none.alias("building"), F.col("type").alias("landuse"))
        )
    return assemble_features(parts, ["terrain", "building", "landuse"], combine=True)


POINT = ("sample_id", "site_id", "longitude", "latitude", "rssi")


def place_features(
    measurements: DataFrame, sites: DataFrame, buildings: DataFrame | None, pixels: DataFrame | None,
    meta: DataFrame | None, landuse: DataFrame | None,
) -> tuple[DataFrame, DataFrame]:
    """(places, points): feature arrays of every distinct position, and the measurements with their ``place_id``.

    Readings at one position of a site see the same map, so its 1,116 cells are looked
    up once however many there are. A place is named after its smallest sample.
    """
    links = materialize(
        with_link_geometry(sample_receivers(measurements, sites, buildings, pixels, meta)), "links"
    )
    position = ["site_id", "longitude", "latitude"]
    geometry = [c for c in links.columns if c not in measurements.columns]
    places = materialize(
        links.groupBy(*position, *geometry).agg(
            F.min("sample_id").alias("sample_id"), F.count(F.lit(1)).alias("_points")
        ),
        "places",
    )
    maps = sample_cells(places, buildings, pixels, meta, landuse)
    # Terrain gaps take the mean over all cells of the site's measurements, 0 where it has none.
    sampled = materialize(
        maps.join(places.select("sample_id", "site_id", "_points"), "sample_id")
        .withColumn("_known", F.filter("terrain", lambda v: v.isNotNull()))
        .withColumn("_n", F.size("_known") * F.col("_points"))
        .withColumn("_sum", F.aggregate("_known", F.lit(0.0), lambda a, v: a + v) * F.col("_points"))
        .drop("_known", "_points"),
        "cells",
    )
    means = sampled.groupBy("site_id").agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias("_mean"))
    joined = salted_join(
        sampled.drop("site_id", "_n", "_sum").join(places.drop("_points"), "sample_id"),
        materialize(means, "means"), ["site_id"],
    )
    altitude = F.zip_with(
        "terrain", "building", lambda t, b: F.coalesce(t, F.col("_mean"), F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
    )

    def height_at(alt: Column, i: Column) -> Column:
        px, py = geo.path_grid_xy(i, F.col("distance_m"), F.col("fresnel_h"))
        x, y = geo.grid_to_metres(px, py, F.col("cos_theta"), F.col("sin_theta"), F.col("cos_phi"))
        return cell_height(alt, x, y)

    no_landuse = F.transform("terrain", lambda _: F.lit(raster.BACKGROUND))
    rows = (
        joined.withColumn("height", F.transform(altitude, height_at))
        .withColumn("step_m", fx.path_step(F.col("distance_m")))
        .withColumn("slope", fx.slope_array(F.col("height"), F.col("step_m")))
        .withColumn("landuse", no_landuse if landuse is None else F.col("landuse"))
    )
    named = rows.select(
        F.col("sample_id").alias("place_id"), "dn", "distance_m", "fresnel_h", "fresnel_v", "freq_mhz", "pt_dbm",
        "height", "slope", "landuse", "step_m",
    )
    at = places.select(F.col("sample_id").alias("place_id"), *[F.col(c).alias(f"_{c}") for c in position])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in position])
    return named, links.select(*POINT).join(at, same).select(*POINT, "place_id")


def at_points(places: DataFrame, points: DataFrame) -> DataFrame:
    """The points with all columns of their place, and the target of each."""
    target = radio.target_value(F.col("rssi"), F.col("pt_dbm"), F.col("freq_mhz"), F.col("distance_m"))
    return salted_join(points, places, ["place_id"]).withColumn("target_db", target).drop("place_id")


def build_features(
    measurements: DataFrame, sites: DataFrame, buildings: DataFrame | None, pixels: DataFrame | None,
    meta: DataFrame | None, landuse: DataFrame | None,
) -> DataFrame:
    """Feature arrays and target of every measurement, all sites in one job."""
    return at_points(*place_features(measurements, sites, buildings, pixels, meta, landuse))


def feature_cells(features: DataFrame, *arrays: str, keep: Sequence[str] = ()) -> DataFrame:
    """Feature arrays as one row per cell, for reports and checks; ``keep`` names columns that every cell repeats."""
    first, *rest = arrays
    out = features.select("*", F.posexplode(first).alias("cell_idx", "_v"))
    return out.select(
        "sample_id", "cell_idx", F.col("_v").alias(first),
        *[F.get(F.col(a), F.col("cell_idx")).alias(a) for a in rest], *keep,
    )


def augment_flip(features: DataFrame) -> DataFrame:
    """Add every link as seen from the other end (same target, slopes negated).

    Both rows come from one row in place, so what ``features`` costs is paid once.
    """
    height, slope, landuse = (F.col(c) for c in ARRAYS)

    def seen(flipped: bool, *arrays: Column) -> Column:
        return F.struct(*[a.alias(c) for a, c in zip(arrays, ARRAYS)], F.lit(flipped).alias("flipped"))

    turned = F.transform(fx.rotate_grid(slope), lambda s: -s)
    both = F.array(
        seen(False, height, slope, landuse), seen(True, fx.rotate_grid(height), turned, fx.rotate_grid(landuse))
    )
    twins = features.select(*[c for c in features.columns if c not in ARRAYS], F.explode(both).alias("_seen"))
    return twins.select(*[F.col(f"_seen.{c}") if c in ARRAYS else c for c in features.columns], "_seen.flipped")
