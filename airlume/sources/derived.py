"""Radio-coverage input tables derived from the given star-schema tables.

One SQL text per table, integer arithmetic on unique keys only, written in the
part of SQL that Spark and DuckDB share, so the oracle starts from the same
rows. ``{name}`` stands for a given table or for another derived one.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
)

DERIVED: dict[str, str] = {
    "tx_sites": """
        select cast(n_nationkey as bigint) site_id,
               133.0e0 + n_nationkey * 0.1e0 tx_lon, 33.0e0 + n_nationkey * 0.05e0 tx_lat,
               cast(100 + n_nationkey as double) tx_alt, 2.0e0 tx_ant_h, 1.8e0 rx_ant_h,
               case n_regionkey % 3 when 0 then 220.0e0 when 1 then 429.0e0 else 920.0e0 end freq_mhz,
               37.0e0 pt_dbm
        from {nation}""",
    "measurements": """
        select cast(s_suppkey as bigint) sample_id, t.site_id,
               t.tx_lon + (((s_suppkey * 7919) % 2001) - 1000.5e0) / 100000.0e0 longitude,
               t.tx_lat + (((s_suppkey * 4729) % 2001) - 1000.5e0) / 100000.0e0 latitude,
               -60.0e0 - ((s_suppkey * 31) % 600) / 10.0e0 rssi
        from {supplier} s join {tx_sites} t on t.site_id = s.s_nationkey""",
    "buildings": """
        select cast(c_custkey as bigint) poly_id, t.site_id,
               t.tx_lon + (((c_custkey * 6007) % 2400) - 1200) / 100000.0e0 xmin,
               t.tx_lat + (((c_custkey * 3571) % 2400) - 1200) / 100000.0e0 ymin,
               (200 + (c_custkey % 7) * 60) / 100000.0e0 w, (200 + (c_custkey % 5) * 60) / 100000.0e0 h,
               cast(3 + c_custkey % 40 as double) measured_height
        from {customer} c join {tx_sites} t on t.site_id = c.c_nationkey""",
    "landuse": """
        select cast(p_partkey as bigint) poly_id, t.site_id,
               t.tx_lon + (((p_partkey * 5003) % 2400) - 1200) / 100000.0e0 xmin,
               t.tx_lat + (((p_partkey * 2953) % 2400) - 1200) / 100000.0e0 ymin,
               (300 + (p_partkey % 7) * 80) / 100000.0e0 w, (300 + (p_partkey % 5) * 80) / 100000.0e0 h,
               cast(p_partkey % 27 as int) type
        from {part} p join {tx_sites} t on t.site_id = p.p_partkey % 25""",
    # Terrain raster: every line item is one sounding, a pixel keeps the highest.
    "raster_cells": """
        select site_id, r, c,
               case when (r * 13 + c * 7 + site_id) % 97 = 0 then -9999.0e0 else max(v) end value
        from (select cast(l_suppkey % 25 as bigint) site_id,
                     cast((l_partkey * 7 + l_orderkey) % 60 as int) r,
                     cast((l_orderkey * 13 + l_linenumber * 5) % 60 as int) c,
                     cast(20 + (l_partkey * 17 + l_orderkey * 29) % 180 as double) v
              from {lineitem}) soundings
        group by site_id, r, c""",
    "raster_meta": """
        select site_id, tx_lon - 0.012e0 x0, tx_lat + 0.012e0 y0, 0.0004e0 dx, 0.0004e0 dy,
               60 nrows, 60 ncols, -9999.0e0 nodata
        from {tx_sites}""",
    # Uncleaned field log. Dataset 0 holds over a third of all rows; blanks and
    # exact repeats occur.
    "field_log": """
        select cast(o_orderkey as bigint) record_id,
               cast(case when o_orderkey % 3 = 0 then 0 else o_custkey % 25 end as bigint) dataset_id,
               case when o_orderkey % 37 = 5 then null
                    else 133.0e0 + ((o_orderkey % 5000) * 53 % 4001) / 100000.0e0 end longitude,
               case when o_orderkey % 41 = 7 then null
                    else 33.0e0 + ((o_orderkey % 5000) * 71 % 4003) / 100000.0e0 end latitude,
               case when o_orderkey % 43 = 9 then null
                    else -50.0e0 - ((o_orderkey % 5000) * 37 % 900) / 10.0e0 end rssi
        from {orders}""",
    # Sampled altitudes with the usual no-data markers and gaps.
    "altitudes": """
        select cast(o_orderkey as bigint) record_id,
               cast(case when o_orderkey % 3 = 0 then 0 else o_custkey % 25 end as bigint) dataset_id,
               case when o_orderkey % 11 = 3 then -9999.0e0 when o_orderkey % 13 = 5 then -32767.0e0
                    when o_orderkey % 17 = 2 then -32768.0e0 when o_orderkey % 19 = 4 then null
                    when o_custkey % 25 = 24 and o_orderkey % 3 <> 0 then null
                    else cast(20 + (o_orderkey * 19) % 300 as double) end dn,
               case when o_orderkey % 7 = 1 then null else cast(3 + o_orderkey % 40 as double) end measured_height,
               case when o_orderkey % 5 = 2 then null else cast(o_orderkey % 27 as double) end type
        from {orders}""",
    # Point readings by fixed stations: many rows share one position.
    "station_heights": """
        select cast(o_orderkey as bigint) record_id,
               133.0e0 + (case when o_orderkey % 3 = 0 then 0 else o_custkey % 400 end) / 1000.0e0 longitude,
               33.0e0 + (case when o_orderkey % 3 = 0 then 0 else o_custkey % 300 end) / 1000.0e0 latitude,
               case when o_orderkey % 4 = 1 then null else cast(3 + o_orderkey % 40 as double) end measured_height
        from {orders}""",
    "areas": """
        select poly_id area_id, xmin lon_min,
               case when poly_id % 11 = 0 then xmin else xmin + w end lon_max, ymin lat_min,
               case when poly_id % 11 = 0 then ymin else ymin + h end lat_max,
               cast(1 + poly_id % 7 as int) n, cast(1 + poly_id % 5 as int) m
        from {buildings}""",
    # Bench calibrations: a few readings at one fixed place.
    "nearfield": """
        select cast(c_custkey as bigint) bench_id, t.site_id,
               t.tx_lon + 0.00001e0 longitude, t.tx_lat + 0.00002e0 latitude,
               cast(1 + c_custkey % 5 as int) n_readings,
               -40.0e0 - (c_custkey % 10) first_rssi
        from {customer} c join {tx_sites} t on t.site_id = c.c_nationkey""",
    "bench_links": """
        select cast(o_orderkey as bigint) link_id,
               case o_orderkey % 3 when 0 then 220.0e0 when 1 then 429.0e0 else 920.0e0 end freq_mhz,
               0.5e0 + (o_orderkey * 7 % 100) / 10.0e0 distance_m,
               2.0e0 + (o_orderkey % 4) gain_tx, 1.5e0 + (o_orderkey % 3) gain_rx,
               0.5e0 + (o_orderkey % 7) / 10.0e0 cable_loss,
               1.25e0 + (o_orderkey % 20) / 10.0e0 antenna_h,
               -40.25e0 - (o_orderkey * 13 % 50) wired_rssi,
               -40.0e0 - (o_orderkey * 17 % 50) wireless_rssi
        from {orders}""",
    "predictions": """
        select cast(o_orderkey as bigint) sample_id, case when o_orderkey % 2 = 0 then '220' else '920' end band,
               -50.0e0 - ((o_orderkey * 37) % 900) / 10.0e0 rssi,
               133.0e0 + ((o_orderkey * 53) % 4001) / 100000.0e0 longitude,
               33.0e0 + ((o_orderkey * 71) % 4003) / 100000.0e0 latitude,
               100.0e0 + (o_orderkey * 53) % 9000 distance_m, 20.0e0 + (o_orderkey * 19) % 300 dn,
               -50.0e0 - ((o_orderkey * 37) % 900) / 10.0e0 + (((o_orderkey * 101) % 401) - 200) / 12.0e0 model_0,
               -50.0e0 - ((o_orderkey * 37) % 900) / 10.0e0 + (((o_orderkey * 118 + 13) % 401) - 200) / 13.0e0 model_1,
               -50.0e0 - ((o_orderkey * 37) % 900) / 10.0e0 + (((o_orderkey * 135 + 52) % 401) - 200) / 14.0e0 model_2,
               -50.0e0 - ((o_orderkey * 37) % 900) / 10.0e0 + (((o_orderkey * 152 + 117) % 401) - 200) / 15.0e0 model_3,
               -50.0e0 - ((o_orderkey * 37) % 900) / 10.0e0 + (((o_orderkey * 169 + 208) % 401) - 200) / 16.0e0 model_4
        from {orders}""",
    "group_probs": """
        select sample_id, cast(g as int) group_id,
               (1.0e0 + (sample_id * 7 + g * 11) % 13)
               / ((1.0e0 + (sample_id * 7) % 13) + (1.0e0 + (sample_id * 7 + 11) % 13)
                  + (1.0e0 + (sample_id * 7 + 22) % 13)) p
        from (select sample_id, 0 g from {predictions} union all select sample_id, 1 g from {predictions}
              union all select sample_id, 2 g from {predictions}) member""",
    "expert_groups": """
        select cast(r_regionkey as int) expert_id, cast(r_regionkey % 3 as int) group_id from {region}""",
}

MODEL_COLUMNS = tuple(f"model_{i}" for i in range(5))


def uses(sql: str) -> list[str]:
    """Tables a text refers to, in order of first use."""
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


@lru_cache(maxsize=None)
def _closure(name: str) -> tuple[str, ...]:
    order: list[str] = []
    for child in uses(DERIVED[name]):
        if child in DERIVED:
            order.extend(n for n in _closure(child) if n not in order)
    return (*order, name)


def oracle_ctes(names: list[str]) -> dict[str, str]:
    """The derived tables ``names`` need, in order, as plain SQL texts."""
    out: dict[str, str] = {}
    for name in names:
        for part in _closure(name):
            out[part] = DERIVED[part].format(**{n: n for n in uses(DERIVED[part])})
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or one derived from the given ones."""
    if name in DERIVED:
        text = DERIVED[name]
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in uses(text)})
    if name not in GIVEN:
        raise KeyError(f"unknown table {name!r}; known: {sorted((*GIVEN, *DERIVED))}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def polygons(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A polygon layer with its rectangles written as closed rings."""
    x1, y1 = F.col("xmin"), F.col("ymin")
    x2, y2 = x1 + F.col("w"), y1 + F.col("h")
    return (
        table(spark, sf_dir, name)
        .withColumn("xs", F.array(x1, x2, x2, x1, x1))
        .withColumn("ys", F.array(y1, y1, y2, y2, y1))
        .drop("xmin", "ymin", "w", "h")
    )
