"""A point on the transmitter has no path and is predicted all the same."""

from __future__ import annotations

from airlume.plans import jobs

SITE = "site_id long, tx_lon double, tx_lat double, tx_alt double, tx_ant_h double, rx_ant_h double, freq_mhz double, pt_dbm double"


def _sites(spark):
    return spark.createDataFrame([(1, 133.0, 33.0, 100.0, 2.0, 1.8, 920.0, 37.0), (2, 134.0, 33.0, 90.0, 2.0, 1.8, 220.0, 37.0)], SITE)


def _points(spark, repeats: int):
    """Readings of four positions, two of them alike but for the site."""
    at = [(1, 133.003, 33.001), (2, 133.003, 33.001), (2, 134.002, 33.002), (1, 132.998, 33.004)]
    rows = [(f"{k:02}-{i}", *p, -60.0 - k - i) for i, p in enumerate(at) for k in range(repeats)]
    return spark.createDataFrame(rows, "sample_id string, site_id long, longitude double, latitude double, rssi double")


def test_point_on_the_transmitter_is_predicted(spark, tmp_path):
    points = _points(spark, 3)
    maps = jobs.Maps(_sites(spark), None, None, None, None)
    fits = jobs.train(maps.features(points), 2, max_iter=1, depth=1).experts
    on = spark.sql("select 'on' sample_id, 1L site_id, 133.0d longitude, 33.0d latitude, -999d rssi")
    out = jobs.predict_points(points.unionByName(on), fits, maps, str(tmp_path), "20240101_000000").collect()
    assert len(out) == 13
