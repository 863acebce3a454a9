"""Ingest, cleaning and sink queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlume.operators import cleaning, ensemble
from airlume.plans import parts
from airlume.plans.geometry_queries import r
from airlume.plans.registry import PARTS, query, rd
from airlume.session import new_folder
from airlume.sources import files
from airlume.sources.derived import MODEL_COLUMNS, table

_ROW = ("longitude", "latitude", "rssi")


def csv_folder(spark: SparkSession, sf: str) -> str:
    """The field log as a folder of CSV exports, one per way users name their columns."""
    folder = new_folder(spark, "exports")
    log = table(spark, sf, "field_log")
    lon, lat, rssi = (F.col(c) for c in _ROW)
    exports = {
        "a_plain": log.select(lat.alias("Latitude"), lon.alias("Longitude"), rssi.alias("RSSI")),
        "b_shuffled": log.select(
            (rssi - 1).alias("rssi"), lat.alias("LATITUDE"), lon.alias("longitude"), F.lit("x").alias("extra")
        ),
        "c_aliases": log.select(lon.alias("lng"), lat.alias("lat"), (rssi - 2).alias("predicted_value")),
        "d_no_rssi": log.select(lat.alias("Latitude"), lon.alias("Longitude")),
        "e_text": log.select(
            lat.alias("Latitude"), lon.alias("Longitude"),
            F.when(F.col("record_id") % 500 == 3, "n.d.").otherwise((rssi - 3).cast("string")).alias("RSSI"),
        ),
        "f_repeat": log.select(lat.alias("Latitude"), lon.alias("Longitude"), rssi.alias("RSSI")),
        "g_log": log.select(
            F.col("record_id").alias("id"), *[F.lit(0).alias(c) for c in files.LOG_COLUMNS[1:7]],
            lat.alias("Latitude"), lon.alias("Longitude"), F.lit("").alias("EncData"), (rssi - 4).alias("RSSI"),
        ),
    }
    for name, rows in exports.items():
        files.write_csv(rows, f"{folder}/{name}.csv")
    return folder


PARTS["complete"] = """
    select longitude, latitude, rssi from {field_log}
    where longitude is not null and latitude is not null and rssi is not null"""


@query("read_measurements", f"""
    select {rd('longitude', 6)} longitude, {rd('latitude', 6)} latitude, {rd('rssi', 6)} rssi
    from (select distinct longitude, latitude, rssi
          from (select * from {{complete}} union all select longitude, latitude, rssi - 1 from {{complete}}
                union all select longitude, latitude, rssi - 4 from {{complete}}) r) q""")
def _read_measurements(spark: SparkSession, sf: str) -> DataFrame:
    rows = files.read_measurements(spark, csv_folder(spark, sf))
    return rows.select(*[r(c, 6).alias(c) for c in _ROW])


@query("read_measurements_aliased", f"""
    select {rd('longitude', 6)} longitude, {rd('latitude', 6)} latitude, {rd('rssi', 6)} rssi
    from (select * from {{complete}} union all select * from {{complete}}
          union all select longitude, latitude, rssi - 1 from {{complete}}
          union all select longitude, latitude, rssi - 2 from {{complete}}
          union all select longitude, latitude, rssi - 3 from {{field_log}}
              where longitude is not null and latitude is not null and rssi is not null and record_id % 500 <> 3
          union all select longitude, latitude, rssi - 4 from {{complete}}) q""")
def _read_measurements_aliased(spark: SparkSession, sf: str) -> DataFrame:
    rows = files.read_measurements_aliased(spark, csv_folder(spark, sf))
    return rows.select(*[r(c, 6).alias(c) for c in _ROW])


_FULL = "longitude is not null and latitude is not null and rssi is not null"


@query("ingest_report", f"""
    select s.source || '.csv' source, count(*) filter (where ok) rows_kept, count(*) filter (where not ok) rows_dropped,
           'merged' status
    from (select n source, {_FULL} and (n <> 'e_text' or record_id % 500 <> 3) ok
          from {{field_log}}, unnest(['a_plain', 'b_shuffled', 'c_aliases', 'e_text', 'f_repeat', 'g_log']) t(n)) s
    group by 1
    union all select 'd_no_rssi.csv', 0, 0, 'skipped: columns not found'""")
def _ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    return files.ingest_report(spark, csv_folder(spark, sf))


@query("grid_points", f"""
    select area_id, cast(i * nn + j as bigint) point_idx, 0 id, 0 "NodeID", 0 "RouteInfo", 0 "DestID", 0 "SendTime",
           0 "SeqID", 0 "RecvTime",
           {rd('lat_min + i * case when mm > 1 then (lat_max - lat_min) / (mm - 1) else 0e0 end', 8)} "Latitude",
           {rd('lon_min + j * case when nn > 1 then (lon_max - lon_min) / (nn - 1) else 0e0 end', 8)} "Longitude",
           0 "EncData", -999 "RSSI"
    from (select *, case when lon_min = lon_max and lat_min = lat_max then 1 else n end nn,
                 case when lon_min = lon_max and lat_min = lat_max then 1 else m end mm from {{areas}}) a,
         range(0, 7) p(j), range(0, 5) q(i)
    where j < nn and i < mm""")
def _grid_points(spark: SparkSession, sf: str) -> DataFrame:
    mesh = files.grid_points(table(spark, sf, "areas"))
    return mesh.withColumns({c: r(c, 8) for c in ("Latitude", "Longitude")})


@query("nearfield_points", f"""
    select bench_id, site_id, {rd('longitude', 6)} longitude, {rd('latitude', 6)} latitude, cast(i as int) reading,
           first_rssi - i * 0.5e0 rssi
    from {{nearfield}}, range(0, 5) t(i) where i < n_readings""")
def _nearfield_points(spark: SparkSession, sf: str) -> DataFrame:
    return files.nearfield_points(benches(spark, sf)).withColumns(
        {"longitude": r("longitude", 6), "latitude": r("latitude", 6)}
    )


def benches(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration benches with their readings as an array."""
    readings = F.transform(
        F.sequence(F.lit(0), F.col("n_readings") - 1), lambda i: F.col("first_rssi") - i * 0.5
    )
    return table(spark, sf, "nearfield").withColumn("rssi_list", readings)


# ---- sinks --------------------------------------------------------------------------------

_PREDICTED = ("sample_id", *MODEL_COLUMNS, "predicted_value", "uncertainty")
_PREDICTED_SQL = f"""
    select sample_id, {', '.join(f'{rd(m)} {m}' for m in MODEL_COLUMNS)}, {rd('predicted_value')} predicted_value,
           uncertainty + 0e0 uncertainty from {{stats}}"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Expert columns with median, rounded spread and absolute error."""
    stats = ensemble.ensemble_stats(table(spark, sf, "predictions"), MODEL_COLUMNS)
    return ensemble.abs_error(ensemble.with_rounded_uncertainty(stats))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        "sample_id", *[r(m).alias(m) for m in MODEL_COLUMNS], r("predicted_value").alias("predicted_value"),
        (F.col("uncertainty") + 0.0).alias("uncertainty"),
    )


@query("write_prediction", _PREDICTED_SQL)
def _write_prediction(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf).select(*_PREDICTED)
    path = files.write_prediction(rows, new_folder(spark, "predictions"), "20240101_000000")
    return _rounded(spark.read.schema(rows.schema).option("header", True).csv(path))


@query("read_latest_prediction", _PREDICTED_SQL)
def _read_latest_prediction(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "predictions")
    rows = predictions(spark, sf).select(*_PREDICTED)
    files.write_prediction(rows.withColumn("predicted_value", F.lit(0.0)), folder, "20240101_000000")
    files.write_prediction(rows, folder, "20240102_000000")
    return _rounded(files.read_latest_prediction(spark, folder, T.StructType(rows.schema.fields)))


# ---- cleaning -----------------------------------------------------------------------------


@query("resolve_columns", f"""
    select record_id, {rd('longitude', 6)} longitude, {rd('latitude', 6)} latitude, {rd('record_id * 0.5e0')} distance_m
    from {{field_log}}""")
def _resolve_columns(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "field_log").select(
        "record_id", F.lit(1.0).alias("x"), F.col("longitude").alias("LON"), F.col("latitude").alias("Lat"),
        (F.col("record_id") * 0.5).alias("disBtwTxRx"),
    )
    return cleaning.resolve_columns(named, area=True).select(
        "record_id", r("longitude", 6).alias("longitude"), r("latitude", 6).alias("latitude"),
        r("distance_m").alias("distance_m"),
    )


@query("drop_incomplete", f"""
    select record_id, {rd('longitude', 6)} longitude, {rd('latitude', 6)} latitude, {rd('rssi', 6)} rssi
    from {{field_log}} where {_FULL}""")
def _drop_incomplete(spark: SparkSession, sf: str) -> DataFrame:
    kept = cleaning.drop_incomplete(table(spark, sf, "field_log"), _ROW)
    return kept.select("record_id", *[r(c, 6).alias(c) for c in _ROW])


@query("dedupe_measurements", f"""
    select {rd('longitude', 6)} longitude, {rd('latitude', 6)} latitude, {rd('rssi', 6)} rssi
    from (select distinct longitude, latitude, rssi from {{field_log}}) q""")
def _dedupe_measurements(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaning.dedupe_measurements(table(spark, sf, "field_log"), _ROW)
    return rows.select(*[r(c, 6).alias(c) for c in _ROW])


PARTS["known_altitudes"] = """
    select *, case when dn in (-9999, -32767, -32768) then null else dn end alt from {altitudes}"""


def _known(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.nodata_to_null(table(spark, sf, "altitudes"), "dn")


@query("nodata_to_null", "select record_id, dataset_id, alt dn from {known_altitudes}")
def _nodata_to_null(spark: SparkSession, sf: str) -> DataFrame:
    return _known(spark, sf).select("record_id", "dataset_id", "dn")


@query("fill_area_mean", f"""
    select record_id, dataset_id, {rd('coalesce(alt, avg(alt) over (partition by dataset_id), 0e0)')} dn
    from {{known_altitudes}}""")
def _fill_area_mean(spark: SparkSession, sf: str) -> DataFrame:
    filled = cleaning.fill_area_mean(_known(spark, sf), "dn", ["dataset_id"])
    return filled.select("record_id", "dataset_id", r("dn").alias("dn"))


@query("fill_default", """
    select record_id, coalesce(measured_height, 0e0) measured_height, cast(coalesce(type, 20) as int) type
    from {altitudes}""")
def _fill_default(spark: SparkSession, sf: str) -> DataFrame:
    filled = cleaning.fill_default(table(spark, sf, "altitudes"), "measured_height", "type")
    return filled.select("record_id", "measured_height", "type")


@query("forward_fill", """
    select record_id, dataset_id, last_value(alt ignore nulls) over (
        partition by dataset_id order by record_id rows between unbounded preceding and current row) dn
    from {known_altitudes}""")
def _forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    filled = cleaning.forward_fill(_known(spark, sf), "dn", ["dataset_id"], "record_id")
    return filled.select("record_id", "dataset_id", "dn")


PARTS["interpolated"] = """
    select record_id, dataset_id, measured_height,
           case when alt is not null then alt when a is null then null when b is null then a
                else a + (b - a) * ((place - ia) * 1e0 / (ib - ia)) end dn
    from (select *, last_value(alt ignore nulls) over before a,
                 last_value(case when alt is not null then place end ignore nulls) over before ia,
                 first_value(alt ignore nulls) over after b,
                 first_value(case when alt is not null then place end ignore nulls) over after ib
          from (select *, row_number() over (partition by dataset_id order by record_id) place
                from {known_altitudes}) k
          window before as (partition by dataset_id order by record_id rows between unbounded preceding and current row),
                 after as (partition by dataset_id order by record_id rows between current row and unbounded following)
         ) q"""


@query("interpolate_linear", f"select record_id, dataset_id, {rd('dn')} dn from {{interpolated}}")
def _interpolate_linear(spark: SparkSession, sf: str) -> DataFrame:
    filled = cleaning.interpolate_linear(_known(spark, sf), "dn", ["dataset_id"], "record_id")
    return filled.select("record_id", "dataset_id", r("dn").alias("dn"))


@query("merge_height", f"""
    select record_id, dataset_id, {rd('dn + coalesce(measured_height, 0e0)')} dn from {{interpolated}}""")
def _merge_height(spark: SparkSession, sf: str) -> DataFrame:
    known = _known(spark, sf)
    heights = table(spark, sf, "altitudes").select("dataset_id", "record_id", "measured_height")
    merged = cleaning.merge_height(
        known.select("dataset_id", "record_id", "dn"), heights, ["dataset_id"], "record_id"
    )
    return merged.select("record_id", "dataset_id", r("dn").alias("dn"))


@query("broadcast_group_max", """
    select record_id, max(measured_height) over (partition by latitude, longitude) measured_height
    from {station_heights}""")
def _broadcast_group_max(spark: SparkSession, sf: str) -> DataFrame:
    out = cleaning.broadcast_group_max(
        table(spark, sf, "station_heights"), "measured_height", ["latitude", "longitude"]
    )
    return out.select("record_id", "measured_height")


@query("input_counts", f"""
    select dataset_id, count(*) filter (where {_FULL}) rows_merged, count(*) filter (where not ({_FULL})) rows_dropped,
           cast(sum(case when longitude is null then 1 else 0 end + case when latitude is null then 1 else 0 end
               + case when rssi is null then 1 else 0 end) as bigint) cells_missing
    from {{field_log}} group by dataset_id""")
def _input_counts(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.input_counts(table(spark, sf, "field_log"), _ROW, ["dataset_id"])


def bin_sql(value: str, lo: str, hi: str, bins: int) -> str:
    """Equal-width bin in SQL; the checked tables never have equal ends."""
    return (
        f"case when {value} >= {lo} - 0.001e0 * ({hi} - {lo}) and {value} <= {hi} then "
        f"cast(least(greatest(ceil(({value} - {lo}) / (({hi} - {lo}) / {bins})) - 1, 0), {bins - 1}) as int) end"
    )


@query("equal_width_bins", f"""
    select sample_id, {bin_sql('distance_m', 'd1', 'd2', 100)} distance_m_bin, {bin_sql('dn', 'n1', 'n2', 20)} dn_bin
    from {{predictions}},
         (select min(distance_m) d1, max(distance_m) d2, min(dn) n1, max(dn) n2 from {{predictions}} where band = '220') e""")
def _equal_width_bins(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "predictions")
    sizes = {"distance_m": 100, "dn": 20}
    edges = cleaning.bin_edges(rows.where("band = '220'"), sizes)
    return cleaning.with_bins(rows, edges, sizes).select("sample_id", "distance_m_bin", "dn_bin")


assert parts.MODELS == list(MODEL_COLUMNS)
