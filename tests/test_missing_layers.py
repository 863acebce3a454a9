"""No row vanishes when a site, a group or a value is missing."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from airlume.functions import geometry as geo
from airlume.operators import cleaning, ensemble, evaluation, links, raster
from airlume.sources import files

PIXELS = "site_id int, r int, c int, value double"
META = "site_id int, x0 double, y0 double, dx double, dy double, nrows int, ncols int"
POLYGON = "site_id int, poly_id long, xs array<double>, ys array<double>, {} {}"


@pytest.fixture
def layers(spark):
    """Two sites; only site 1 has layers."""
    square = lambda x, y, d: ([x, x + d, x + d, x, x], [y, y, y + d, y + d, y])
    xs, ys = square(133.0, 33.0, 0.004)
    return {
        "sites": spark.createDataFrame(
            [(s, 133.001, 33.001, 10.0, 30.0, 5.0, 2.0, 220.0) for s in (1, 2)],
            "site_id int, tx_lon double, tx_lat double, tx_alt double, pt_dbm double, tx_ant_h double, rx_ant_h double, freq_mhz double",
        ),
        "buildings": spark.createDataFrame([(1, 1, xs, ys, 7.0)], POLYGON.format("measured_height", "double")),
        "pixels": spark.createDataFrame([(1, r, c, 50.0) for r in range(10) for c in range(10)], PIXELS),
        "meta": spark.createDataFrame([(1, 133.0, 33.005, 0.0005, 0.0005, 10, 10)], META),
        "landuse": spark.createDataFrame([(1, 1, xs, ys, 5)], POLYGON.format("type", "int")),
    }


@pytest.fixture
def points(spark):
    rows = [(10 * s + i, s, 133.002 + i * 1e-4, 33.002, -70.0) for s in (1, 2) for i in range(2)]
    return spark.createDataFrame(rows, "sample_id long, site_id int, longitude double, latitude double, rssi double")


@pytest.mark.parametrize("absent", [(), ("pixels", "meta"), ("landuse",), ("buildings",), ("pixels", "meta", "landuse", "buildings")])
def test_every_sample_has_all_its_cells(layers, points, absent):
    given = layers | dict.fromkeys(absent)
    rows = links.build_features(points, **given).collect()
    assert sorted(r.sample_id for r in rows) == [10, 11, 20, 21]
    for r in rows:
        assert len(r.height) == len(r.slope) == len(r.landuse) == geo.GRID_CELLS
        assert None not in r.height and None not in r.landuse
        if r.site_id == 2:
            assert r.dn == 0.0 and set(r.landuse) == {raster.BACKGROUND}


def test_points_without_a_raster_stay(layers, points):
    got = raster.raster_point_sample(points, layers["pixels"], layers["meta"]).collect()
    assert {(r.site_id, r.dn) for r in got} == {(1, 50.0), (2, None)} and len(got) == 4


def test_interpolation_follows_row_position_in_missing_groups_too(spark):
    rows = [(g, i, v) for g in ("a", None) for i, v in zip((1, 2, 10, 40, 41), (10.0, None, 20.0, None, None), strict=True)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    got = cleaning.interpolate_linear(df, "v", ["g"], "i").orderBy("g", "i").collect()
    want = pd.Series([10.0, None, 20.0, None, None]).interpolate("linear").tolist()
    assert [r.v for r in got] == want + want
    ahead = cleaning.forward_fill(df, "v", ["g"], "i", block_rows=2).orderBy("g", "i").collect()
    assert [r.v for r in ahead] == [10.0, 10.0, 20.0, 20.0, 20.0] * 2


def test_groups_of_reports_are_whole(spark):
    rows = [("220", float(u), 1.0) for u in range(1, 3)] + [("920", float(u), 20.0) for u in (1, 4, 7)] + [("920", None, 99.0)]
    df = spark.createDataFrame(rows, "band string, uncertainty double, abs_error double")
    boxes = {(r.band, r.bin): r.n for r in evaluation.uncertainty_bin_boxes(df).collect()}
    assert boxes == {(b, x): n for b, x, n in [("220", "0-3 dB", 2), ("220", "3-5 dB", 0), ("220", "> 5 dB", 0), ("920", "0-3 dB", 1), ("920", "3-5 dB", 1), ("920", "> 5 dB", 1)]}
    rates = {(r.band, r.segment): (r.n, r.pct_high) for r in evaluation.quantile_high_error_rate(df, 10.0).collect()}
    assert rates == {("220", "low"): (1, 0.0), ("220", "mid"): (0, 0.0), ("220", "high"): (1, 0.0), ("920", "low"): (1, 100.0), ("920", "mid"): (1, 100.0), ("920", "high"): (1, 100.0)}
    assert sum(r.n for r in evaluation.quantile_boxes(df).collect()) == 5


def test_experts_beyond_the_slots_are_reported(spark):
    df = spark.createDataFrame([(31, 1.0), (2, 2.0)], "best_model_idx int, best_model_error double")
    got = {r.expert_id: r.n for r in evaluation.boxes_per_expert(df, ["best_model_error"]).collect()}
    assert got == {i: int(i in (2, 31)) for i in [*range(30), 31]}


def test_mixture_keeps_samples_without_groups(spark):
    df = spark.createDataFrame([(1, 4.0, 8.0), (2, 1.0, 1.0)], "sample_id long, model_0 double, model_1 double")
    probs = spark.createDataFrame([(1, 0, 0.25), (1, 1, 0.75)], "sample_id long, group_id int, p double")
    groups = spark.createDataFrame([(0, 0), (1, 1)], "expert_id int, group_id int")
    got = ensemble.mixture_of_experts(df, ["model_0", "model_1"], probs, groups, 2, offset=F.lit(-100.0))
    assert {r.sample_id: r.moe for r in got.collect()} == {1: -93.0, 2: None}


def test_stored_features_are_replaced_not_doubled(spark, tmp_path):
    rows = lambda d, n: spark.createDataFrame([(d, i, [1.0]) for i in range(n)], "dataset_id int, sample_id long, height array<double>")
    folder = str(tmp_path / "features")
    files.write_features(rows(1, 3).unionByName(rows(2, 2)), folder)
    files.write_features(rows(1, 4), folder)
    assert sorted(r.dataset_id for r in files.read_feature_sets(spark, folder, [1, 2]).collect()) == [1] * 4 + [2] * 2


def test_report_counts_what_the_reader_keeps(spark, tmp_path):
    (tmp_path / "a.csv").write_text("longitude,latitude,rssi\n133,33,-70\n133,33,nan\n133,33,bad\n133,33,5d\n")
    kept = files.read_measurements_aliased(spark, str(tmp_path)).count()
    report = files.ingest_report(spark, str(tmp_path)).first()
    assert (kept, report.rows_kept, report.rows_dropped) == (1, 1, 3)
