"""Link geometry, map sampling and feature queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlume.functions import features as fx
from airlume.functions import geometry as geo
from airlume.functions import radio
from airlume.operators import cleaning, links, raster, spatial
from airlume.plans import parts
from airlume.plans.registry import query, rd
from airlume.session import materialize, new_folder, shuffle_width
from airlume.sources import files
from airlume.sources.derived import polygons, table

ARRAYS = ("height", "slope", "landuse")


def r(value: Column | str, digits: int = 4) -> Column:
    """Rounded number (a double) without a negative zero, equal to ``F.round`` in every bit.

    ``F.round`` goes through decimal text. Away from a tie the nearest whole number of
    steps, divided by their number per unit, is the same double at a tenth of the cost.
    """
    scale = float(10**digits)
    steps = (F.col(value) if isinstance(value, str) else value) * scale
    whole = F.rint(steps)
    # Below 1e12 steps, product and text are off by less than 1e-3 of a step.
    safe = (F.abs(steps) < 1e12) & (F.abs(steps - whole) < 0.499)
    return F.when(safe, whole / scale).otherwise(F.round(value, digits)) + F.lit(0.0)


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Terrain pixels, derived from all soundings; written once because features read them twice."""
    return materialize(table(spark, sf, "raster_cells"), "pixels")


def receivers(spark: SparkSession, sf: str) -> DataFrame:
    return links.sample_receivers(
        table(spark, sf, "measurements"), table(spark, sf, "tx_sites"), polygons(spark, sf, "buildings"),
        table(spark, sf, "raster_cells"), table(spark, sf, "raster_meta"),
    )


def link_table(spark: SparkSession, sf: str) -> DataFrame:
    """Receivers with geometry, written once because the path grid multiplies them."""
    return materialize(links.with_link_geometry(receivers(spark, sf)), "links")


def cell_boxes(spark: SparkSession, sf: str) -> DataFrame:
    cells = links.with_footprints(links.grid_to_geo(links.path_cells(link_table(spark, sf))))
    return cells.select("site_id", "sample_id", "cell_idx", "rx1", "ry1", "rx2", "ry2")


def features(spark: SparkSession, sf: str) -> DataFrame:
    return links.build_features(
        table(spark, sf, "measurements"), table(spark, sf, "tx_sites"), polygons(spark, sf, "buildings"),
        pixels(spark, sf), table(spark, sf, "raster_meta"), polygons(spark, sf, "landuse"),
    )


def surface_cells(link_rows: DataFrame) -> DataFrame:
    """Cells with a made altitude and land use, for operators that start from those."""
    cells = links.grid_to_geo(links.path_cells(link_rows))
    return links.with_cell_height(
        cells.withColumns(
            {
                "dn_cell": (50 + (F.col("sample_id") * 13 + F.col("cell_idx") * 29) % 170).cast("double"),
                "type": ((F.col("sample_id") * 7 + F.col("cell_idx") * 5) % 27).cast("int"),
            }
        )
    )


def surface_features(spark: SparkSession, sf: str) -> DataFrame:
    link_rows = link_table(spark, sf)
    cells = surface_cells(link_rows).withColumnRenamed("type", "landuse")
    arrays = links.assemble_features(cells, ["height", "landuse"])
    facts = link_rows.select("sample_id", "site_id", "rssi", "pt_dbm", "distance_m", "freq_mhz")
    # Dealt like the arrays and hashed: these wide rows are neither moved nor sorted again.
    facts = facts.repartition(shuffle_width(spark), "sample_id").hint("shuffle_hash")
    return (
        arrays.join(facts, "sample_id")
        .withColumn("step_m", fx.path_step(F.col("distance_m")))
        .withColumn("slope", fx.slope_array(F.col("height"), F.col("step_m")))
    )


# ---- sites, distances, angles -------------------------------------------------------------


@query("join_site_params", f"""
    select m.sample_id, m.site_id, {rd('m.rssi')} rssi, s.tx_lon, s.tx_lat, s.tx_alt, s.tx_ant_h, s.rx_ant_h,
           s.freq_mhz, s.pt_dbm
    from {{measurements}} m join {{tx_sites}} s on s.site_id = m.site_id""")
def _join_site_params(spark: SparkSession, sf: str) -> DataFrame:
    joined = links.join_site_params(table(spark, sf, "measurements"), table(spark, sf, "tx_sites"))
    return joined.select(
        "sample_id", "site_id", r("rssi").alias("rssi"), "tx_lon", "tx_lat", "tx_alt", "tx_ant_h", "rx_ant_h",
        "freq_mhz", "pt_dbm",
    )


@query("ll_to_meter", f"select sample_id, {rd('x_m')} x_m, {rd('y_m')} y_m from {{metres}}")
def _ll_to_meter(spark: SparkSession, sf: str) -> DataFrame:
    rows = links.join_site_params(table(spark, sf, "measurements"), table(spark, sf, "tx_sites"))
    x, y = geo.ll_to_meter(F.col("longitude"), F.col("latitude"), F.col("tx_lon"), F.col("tx_lat"))
    return rows.select("sample_id", r(x).alias("x_m"), r(y).alias("y_m"))


@query("meter_to_ll", f"""
    select m.sample_id, {rd('degrees(radians(s.tx_lon) + dx / (6371000e0 * cos(radians(s.tx_lat))))', 9)} longitude,
           {rd('degrees(radians(s.tx_lat) + dy / 6371000e0)', 9)} latitude
    from (select *, sample_id * 37 % 5000 - 2500.5e0 dx, sample_id * 53 % 7000 - 3500.5e0 dy from {{measurements}}) m
    join {{tx_sites}} s on s.site_id = m.site_id""")
def _meter_to_ll(spark: SparkSession, sf: str) -> DataFrame:
    rows = links.join_site_params(table(spark, sf, "measurements"), table(spark, sf, "tx_sites"))
    dx, dy = F.col("sample_id") * 37 % 5000 - 2500.5, F.col("sample_id") * 53 % 7000 - 3500.5
    lon, lat = geo.meter_to_ll(dx, dy, F.col("tx_lon"), F.col("tx_lat"))
    return rows.select("sample_id", r(lon, 9).alias("longitude"), r(lat, 9).alias("latitude"))


@query("link_distance", f"select sample_id, {rd('distance_m')} distance_m from {{links}}")
def _link_distance(spark: SparkSession, sf: str) -> DataFrame:
    return links.with_link_geometry(receivers(spark, sf)).select("sample_id", r("distance_m").alias("distance_m"))


@query("fresnel_radii", f"select sample_id, {rd('fresnel_h')} fresnel_h, {rd('fresnel_v')} fresnel_v from {{links}}")
def _fresnel_radii(spark: SparkSession, sf: str) -> DataFrame:
    return links.with_link_geometry(receivers(spark, sf)).select(
        "sample_id", r("fresnel_h").alias("fresnel_h"), r("fresnel_v").alias("fresnel_v")
    )


@query("link_rotation", f"""
    select sample_id, {rd('cos_phi * cos_theta', 8)} h11, {rd('cos_phi * sin_theta', 8)} h12, {rd('sin_phi', 8)} h13,
           {rd('-sin_theta', 8)} h21, {rd('cos_theta', 8)} h22, 0e0 h23,
           {rd('-sin_phi * cos_theta', 8)} h31, {rd('-sin_phi * sin_theta', 8)} h32, {rd('cos_phi', 8)} h33
    from {{links}}""")
def _link_rotation(spark: SparkSession, sf: str) -> DataFrame:
    h = geo.rotation_matrix(F.col("cos_theta"), F.col("sin_theta"), F.col("cos_phi"), F.col("sin_phi"))
    rows = links.with_link_geometry(receivers(spark, sf))
    return rows.select("sample_id", *[r(v, 8).alias(k) for k, v in h.items()])


@query("path_grid", f"select sample_id, cell_idx, {rd('px')} px, {rd('py')} py from {{grid}}")
def _path_grid(spark: SparkSession, sf: str) -> DataFrame:
    cells = links.path_cells(link_table(spark, sf))
    return cells.select("sample_id", "cell_idx", r("px").alias("px"), r("py").alias("py"))


@query("grid_to_geo", f"""
    select sample_id, cell_idx, {rd('cell_lon', 8)} longitude, {rd('cell_lat', 8)} latitude from {{cells}}""")
def _grid_to_geo(spark: SparkSession, sf: str) -> DataFrame:
    cells = links.grid_to_geo(links.path_cells(link_table(spark, sf)))
    return cells.select(
        "sample_id", "cell_idx", r("cell_lon", 8).alias("longitude"), r("cell_lat", 8).alias("latitude")
    )


@query("footprint_rect", f"""
    select sample_id, cell_idx, {rd('rx1', 8)} rx1, {rd('ry1', 8)} ry1, {rd('rx2', 8)} rx2, {rd('ry2', 8)} ry2
    from {{boxes}}""")
def _footprint_rect(spark: SparkSession, sf: str) -> DataFrame:
    boxes = cell_boxes(spark, sf)
    return boxes.select("sample_id", "cell_idx", *[r(c, 8).alias(c) for c in ("rx1", "ry1", "rx2", "ry2")])


@query("cell_height", f"select sample_id, cell_idx, {rd('height')} height from {{surface_heights}}")
def _cell_height(spark: SparkSession, sf: str) -> DataFrame:
    cells = surface_cells(link_table(spark, sf))
    return cells.select("sample_id", "cell_idx", r("height").alias("height"))


@query("haversine", f"""
    select sample_id, {rd('''2 * atan2(sqrt(a), sqrt(1 - a)) * 6371.0088e0 * 1000''')} distance_m
    from (select sample_id, power(sin(radians(34e0 - latitude) / 2), 2)
             + cos(radians(latitude)) * cos(radians(34e0)) * power(sin(radians(134e0 - longitude) / 2), 2) a
          from {{predictions}}) q""")
def _haversine(spark: SparkSession, sf: str) -> DataFrame:
    d = geo.haversine(F.col("longitude"), F.col("latitude"), F.lit(134.0), F.lit(34.0))
    return table(spark, sf, "predictions").select("sample_id", r(d).alias("distance_m"))


# ---- power --------------------------------------------------------------------------------


@query("path_loss", f"""
    select sample_id, {rd(parts.loss(2))} path_loss_eta_2, {rd(parts.loss(3))} path_loss_eta_3 from {{links}}""")
def _path_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = links.with_link_geometry(receivers(spark, sf))
    args = (F.col("pt_dbm"), F.col("freq_mhz"), F.col("distance_m"))
    return rows.select(
        "sample_id", r(radio.path_loss(*args, 2)).alias("path_loss_eta_2"),
        r(radio.path_loss(*args, 3)).alias("path_loss_eta_3"),
    )


@query("target_value", f"select sample_id, {rd('rssi - ' + parts.loss(2))} target_db from {{links}}")
def _target_value(spark: SparkSession, sf: str) -> DataFrame:
    rows = links.with_link_geometry(receivers(spark, sf))
    target = radio.target_value(F.col("rssi"), F.col("pt_dbm"), F.col("freq_mhz"), F.col("distance_m"))
    return rows.select("sample_id", r(target).alias("target_db"))


@query("free_space_residual", f"""
    select sample_id, site_id, {rd('distance_m')} distance_m, {rd('rssi - ' + parts.loss(2))} target_db from {{links}}""")
def free_space_residual(spark: SparkSession, sf: str) -> DataFrame:
    rows = links.with_link_geometry(receivers(spark, sf))
    target = radio.target_value(F.col("rssi"), F.col("pt_dbm"), F.col("freq_mhz"), F.col("distance_m"))
    return rows.select("sample_id", "site_id", r("distance_m").alias("distance_m"), r(target).alias("target_db"))


@query("restore_rssi", f"""
    select sample_id, {rd(parts.loss(2) + " + (sample_id % 40 - 20.5e0)")} rssi from {{links}}""")
def _restore_rssi(spark: SparkSession, sf: str) -> DataFrame:
    rows = links.with_link_geometry(receivers(spark, sf))
    target = F.col("sample_id") % 40 - 20.5
    back = radio.restore_rssi(target, F.col("pt_dbm"), F.col("freq_mhz"), F.col("distance_m"))
    return rows.select("sample_id", r(back).alias("rssi"))


_FSPL = "(case freq_mhz when 220 then 19.3e0 when 429 then 25.1e0 else 31.7e0 end + 20 * log10(distance_m))"


@query("fspl_budget", f"""
    select link_id, {rd(_FSPL)} fspl_db, {rd(_FSPL + ' - (gain_tx + gain_rx) - cable_loss')} attenuator_db
    from {{bench_links}}""")
def _fspl_budget(spark: SparkSession, sf: str) -> DataFrame:
    f, d = F.col("freq_mhz"), F.col("distance_m")
    setting = radio.attenuator_setting(f, d, F.col("gain_tx"), F.col("gain_rx"), F.col("cable_loss"))
    return table(spark, sf, "bench_links").select(
        "link_id", r(radio.fspl(f, d)).alias("fspl_db"), r(setting).alias("attenuator_db")
    )


@query("calibration_check", """
    select link_id, case when distance_m < 1 then 'near_field'
        when antenna_h <= case freq_mhz when 220 then 2.5e0 when 429 then 1.8e0 else 1.5e0 end then 'antenna_too_low'
        when abs(wired_rssi - wireless_rssi) <= 3 then 'calibrated' else 'deviates' end status
    from {bench_links}""")
def _calibration_check(spark: SparkSession, sf: str) -> DataFrame:
    status = radio.calibration_status(
        F.col("wired_rssi"), F.col("wireless_rssi"), F.col("distance_m"), F.col("antenna_h"), F.col("freq_mhz"), 3.0
    )
    return table(spark, sf, "bench_links").select("link_id", status.alias("status"))


_CLASSES = ", ".join(f"'{c}'" for c in radio.LANDUSE_CLASSES)


@query("landuse_code", f"""
    select p_partkey poly_id,
           cast(coalesce(list_position([{_CLASSES}], [{_CLASSES}][p_partkey % 28]), 0) as int) code
    from {{part}}""")
def _landuse_code(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in radio.LANDUSE_CLASSES])
    place = (F.col("p_partkey") % 28).cast("int")
    named = F.when(place.between(1, 26), F.get(names, place - 1)).when(place == 27, "unlisted class")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("poly_id"), radio.landuse_code(named).alias("code")
    )


# ---- features -----------------------------------------------------------------------------


@query("slope", f"select sample_id, cell_idx, {rd('slope', 6)} slope from {{surface_cells}}")
def _slope(spark: SparkSession, sf: str) -> DataFrame:
    return links.feature_cells(surface_features(spark, sf), "slope").select(
        "sample_id", "cell_idx", r("slope", 6).alias("slope")
    )


@query("assemble_features", f"""
    select sample_id, cell_idx, {rd('height')} height, {rd('slope', 6)} slope, type landuse from {{surface_cells}}""")
def _assemble_features(spark: SparkSession, sf: str) -> DataFrame:
    return links.feature_cells(surface_features(spark, sf), *ARRAYS).select(
        "sample_id", "cell_idx", r("height").alias("height"), r("slope", 6).alias("slope"), "landuse"
    )


@query("scale_channels", f"""
    select sample_id, cell_idx, {rd('(height + 500) / 1000', 7)} height, {rd('slope / (pi() / 2)', 6)} slope, type landuse,
           {rd('freq_mhz / 1000', 6)} freq, {rd('distance_m / 29 / 1000', 6)} step from {{surface_cells}}""")
def _scale_channels(spark: SparkSession, sf: str) -> DataFrame:
    scaled = surface_features(spark, sf).withColumns(
        {
            "height": F.transform("height", fx.scale_height), "slope": F.transform("slope", fx.scale_slope),
            "freq": r(fx.scale_thousand(F.col("freq_mhz")), 6), "step": r(fx.scale_thousand(F.col("step_m")), 6),
        }
    )
    return links.feature_cells(scaled, *ARRAYS, keep=["freq", "step"]).select(
        "sample_id", "cell_idx", r("height", 7).alias("height"), r("slope", 6).alias("slope"), "landuse", "freq", "step"
    )


@query("augment_flip", f"""
    select sample_id, cell_idx, false flipped, {rd('height')} height, {rd('slope', 6)} slope, type landuse
    from {{surface_cells}}
    union all
    select sample_id, 1115 - cell_idx, true, {rd('height')}, {rd('-slope', 6)}, type from {{surface_cells}}""")
def _augment_flip(spark: SparkSession, sf: str) -> DataFrame:
    both = links.augment_flip(surface_features(spark, sf))
    out = both.select("sample_id", "flipped", F.posexplode("height").alias("cell_idx", "h"), "slope", "landuse")
    return out.select(
        "sample_id", "cell_idx", "flipped", r("h").alias("height"),
        r(F.get("slope", F.col("cell_idx")), 6).alias("slope"), F.get("landuse", F.col("cell_idx")).alias("landuse"),
    )


@query("select_channels", f"""
    select sample_id, cell_idx, {rd('height')} height, type landuse from {{surface_cells}}""")
def _select_channels(spark: SparkSession, sf: str) -> DataFrame:
    cells = links.feature_cells(surface_features(spark, sf), *ARRAYS)
    return cleaning.select_channels(cells, ARRAYS, (1, 0, 1)).withColumn("height", r("height"))


# ---- joins with maps ----------------------------------------------------------------------


@query("raster_cells", "select site_id, r, c, value from {raster_cells}")
def _raster_cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raster_cells")


@query("polygon_layer", f"""
    select poly_id, site_id, measured_height, {rd('xmin', 6)} x1, {rd('ymin', 6)} y1, {rd('xmin + w', 6)} x2,
           {rd('ymin + h', 6)} y2, 5 n_points from {{buildings}}""")
def _polygon_layer(spark: SparkSession, sf: str) -> DataFrame:
    return polygons(spark, sf, "buildings").select(
        "poly_id", "site_id", "measured_height", r(F.array_min("xs"), 6).alias("x1"),
        r(F.array_min("ys"), 6).alias("y1"), r(F.array_max("xs"), 6).alias("x2"),
        r(F.array_max("ys"), 6).alias("y2"), F.size("xs").alias("n_points"),
    )


@query("point_in_polygon_join", """
    select m.sample_id, m.site_id, coalesce(h.h, 0e0) measured_height
    from {measurements} m left join {housed} h on h.sample_id = m.sample_id""")
def _point_in_polygon_join(spark: SparkSession, sf: str) -> DataFrame:
    joined = spatial.point_in_polygon_join(
        table(spark, sf, "measurements"), polygons(spark, sf, "buildings"), "measured_height", 0.0
    )
    return joined.select("sample_id", "site_id", "measured_height")


@query("footprint_max_height", """
    select b.sample_id, b.cell_idx, h.bh measured_height from {boxes} b
    left join {box_heights} h on h.sample_id = b.sample_id and h.cell_idx = b.cell_idx""")
def _footprint_max_height(spark: SparkSession, sf: str) -> DataFrame:
    out = spatial.footprint_max_height(cell_boxes(spark, sf), polygons(spark, sf, "buildings"), links.CELL)
    return out.select("sample_id", "cell_idx", "measured_height")


@query("raster_point_sample", "select sample_id, site_id, raw dn from {terrain}")
def _raster_point_sample(spark: SparkSession, sf: str) -> DataFrame:
    out = raster.raster_point_sample(
        table(spark, sf, "measurements"), table(spark, sf, "raster_cells"), table(spark, sf, "raster_meta")
    )
    return out.select("sample_id", "site_id", "dn")


@query("raster_window_max", "select sample_id, cell_idx, alt dn from {dem_max}")
def _raster_window_max(spark: SparkSession, sf: str) -> DataFrame:
    out = raster.raster_window_max(
        cell_boxes(spark, sf), table(spark, sf, "raster_cells"), table(spark, sf, "raster_meta")
    )
    return out.select("sample_id", "cell_idx", "dn")


@query("rasterize_polygons", "select site_id, r, c, type from {burned}")
def _rasterize_polygons(spark: SparkSession, sf: str) -> DataFrame:
    layer = polygons(spark, sf, "landuse")
    return raster.rasterize_polygons(layer, raster.layer_grid(layer))


@query("footprint_landuse_mode", """
    select b.sample_id, b.cell_idx, coalesce(m.type, 20) type from {boxes} b
    left join {lu_mode} m on m.sample_id = b.sample_id and m.cell_idx = b.cell_idx""")
def _footprint_landuse_mode(spark: SparkSession, sf: str) -> DataFrame:
    out = raster.footprint_landuse_mode(cell_boxes(spark, sf), polygons(spark, sf, "landuse"))
    return out.select("sample_id", "cell_idx", "type")


_AREA = """round((least(b.xmin + b.w, l.xmin + l.w) - greatest(b.xmin, l.xmin))
               * (least(b.ymin + b.h, l.ymin + l.h) - greatest(b.ymin, l.ymin)) * 1e8, 6)"""


@query("largest_overlap_join", f"""
    select b.poly_id box_id, b.site_id, o.type
    from {{buildings}} b left join (
        select box_id, type from (
            select b.poly_id box_id, l.type,
                   row_number() over (partition by b.poly_id order by {_AREA} desc, l.poly_id) k
            from {{buildings}} b join {{landuse}} l on l.site_id = b.site_id
             and b.xmin <= l.xmin + l.w and b.xmin + b.w >= l.xmin
             and b.ymin <= l.ymin + l.h and b.ymin + b.h >= l.ymin) q where k = 1) o on o.box_id = b.poly_id""")
def _largest_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    boxes = table(spark, sf, "buildings").select(
        F.col("poly_id").alias("box_id"), "site_id", F.col("xmin").alias("rx1"), F.col("ymin").alias("ry1"),
        (F.col("xmin") + F.col("w")).alias("rx2"), (F.col("ymin") + F.col("h")).alias("ry2"),
    )
    out = spatial.largest_overlap_join(boxes, polygons(spark, sf, "landuse"), "type", "box_id")
    return out.select("box_id", "site_id", "type")


@query("order_by_index", f"""
    select sample_id, cell_idx, {rd('height')} height from {{surface_heights}} order by cell_idx, sample_id""")
def _order_by_index(spark: SparkSession, sf: str) -> DataFrame:
    from airlume.operators.splits import order_by_index

    cells = surface_cells(link_table(spark, sf)).select("sample_id", "cell_idx", r("height").alias("height"))
    # A cell keeps about a tenth of what its link holds.
    return order_by_index(cells, ["cell_idx", "sample_id"], geo.GRID_CELLS // 10)


# ---- whole jobs ---------------------------------------------------------------------------

_FEATURES_SQL = f"""
    select sample_id, cell_idx, site_id, {rd('height')} height, {rd('slope', 6)} slope, type landuse,
           {rd('distance_m')} distance_m, {rd('rssi - ' + parts.loss(2))} target_db from {{feature_cells}}"""


@query("job_build_features", _FEATURES_SQL)
def job_build_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = features(spark, sf)
    exploded = rows.select(
        "sample_id", F.posexplode("height").alias("cell_idx", "h"), "site_id", "slope", "landuse", "distance_m", "target_db"
    )
    at = F.col("cell_idx")
    return exploded.select(
        "sample_id", "cell_idx", "site_id", r("h").alias("height"), r(F.get("slope", at), 6).alias("slope"),
        F.get("landuse", at).alias("landuse"), r("distance_m").alias("distance_m"), r("target_db").alias("target_db"),
    )


_STORED_SQL = f"""
    select sample_id, site_id dataset_id, {rd('distance_m')} distance_m, freq_mhz, pt_dbm,
           {rd('rssi - ' + parts.loss(2))} target_db from {{links}}"""


def stored_features(spark: SparkSession, sf: str) -> str:
    """Feature sets of all sites, stored one directory per dataset."""
    folder = new_folder(spark, "feature-sets")
    rows = surface_features(spark, sf)
    target = radio.target_value(F.col("rssi"), F.col("pt_dbm"), F.col("freq_mhz"), F.col("distance_m"))
    files.write_features(
        rows.withColumn("target_db", target).withColumnRenamed("site_id", "dataset_id"), folder
    )
    return folder


@query("write_features", _STORED_SQL)
def _write_features(spark: SparkSession, sf: str) -> DataFrame:
    stored = spark.read.parquet(stored_features(spark, sf))
    return stored.select(
        "sample_id", F.col("dataset_id").cast("long").alias("dataset_id"), r("distance_m").alias("distance_m"),
        "freq_mhz", "pt_dbm", r("target_db").alias("target_db"),
    )


@query("read_feature_sets", _STORED_SQL + " where site_id in (0, 3, 7, 11, 20)")
def _read_feature_sets(spark: SparkSession, sf: str) -> DataFrame:
    chosen = files.read_feature_sets(spark, stored_features(spark, sf), [0, 3, 7, 11, 20])
    return chosen.select(
        "sample_id", F.col("dataset_id").cast("long").alias("dataset_id"), r("distance_m").alias("distance_m"),
        "freq_mhz", "pt_dbm", r("target_db").alias("target_db"),
    )
