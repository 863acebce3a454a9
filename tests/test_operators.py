from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airlume.functions import features as fx
from airlume.functions import geometry as geo
from airlume.functions import radio
from airlume.operators import cleaning, ensemble, experts, links, raster, spatial, splits
from airlume.operators.skew import hot_keys, salted_join


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


# ---- formulas -----------------------------------------------------------------------------


@pytest.mark.parametrize(("mhz", "db"), [(220, 19.29), (429, 25.09), (920, 31.72)])
def test_free_space_loss_at_one_metre(spark, mhz, db):
    row = one(spark, p=radio.path_loss(F.lit(0.0), F.lit(float(mhz)), F.lit(1.0), 2))
    assert -row["p"] == pytest.approx(db, abs=0.02)


def test_metres_and_back(spark):
    x, y = geo.ll_to_meter(F.lit(133.05), F.lit(33.21), F.lit(133.0), F.lit(33.2))
    lon, lat = geo.meter_to_ll(x, y, F.lit(133.0), F.lit(33.2))
    row = one(spark, lon=lon, lat=lat)
    assert row["lon"] == pytest.approx(133.05, abs=1e-10)
    assert row["lat"] == pytest.approx(33.21, abs=1e-10)


def test_rotation_is_orthonormal_and_null_at_the_transmitter(spark):
    a = geo.rotation_angles(F.lit(300.0), F.lit(-400.0), F.lit(50.0))
    h = geo.rotation_matrix(a["cos_theta"], a["sin_theta"], a["cos_phi"], a["sin_phi"])
    m = np.array(list(one(spark, **h).asDict().values())).reshape(3, 3)
    np.testing.assert_allclose(m @ m.T, np.eye(3), atol=1e-12)
    a = geo.rotation_angles(F.lit(0.0), F.lit(0.0), F.lit(5.0))
    assert set(one(spark, **a).asDict().values()) == {None}


def test_slope_of_a_ramp_is_constant_and_flip_twice_is_identity(spark):
    cells = range(geo.GRID_CELLS)
    df = spark.createDataFrame(
        [(1, [2.0 * (i % geo.GRID_COLS) for i in cells], [i % 27 for i in cells])],
        "sample_id int, height array<double>, landuse array<int>",
    ).withColumn("slope", fx.slope_array(F.col("height"), F.lit(2.0)))
    slope = df.first()["slope"]
    np.testing.assert_allclose(slope, math.atan(1.0) / (math.pi / 2))
    twice = links.augment_flip(links.augment_flip(df).where("flipped").drop("flipped")).where("flipped")
    assert twice.first()["height"] == df.first()["height"]
    np.testing.assert_allclose(twice.first()["slope"], slope)


# ---- rings against brute force ------------------------------------------------------------


def shapely_free_contains(x, y, xs, ys):
    """Winding angle of the ring around the point."""
    total = 0.0
    for x1, y1, x2, y2 in zip(xs, ys, xs[1:], ys[1:], strict=False):
        a = math.atan2(y1 - y, x1 - x)
        b = math.atan2(y2 - y, x2 - x)
        d = (b - a + math.pi) % (2 * math.pi) - math.pi
        total += d
    return abs(total) > math.pi


def star(cx, cy, r, seed):
    rng = np.random.default_rng(seed)
    angles = np.sort(rng.uniform(0, 2 * math.pi, 9))
    radii = r * rng.uniform(0.3, 1.0, 9)
    xs = (cx + radii * np.cos(angles)).tolist()
    ys = (cy + radii * np.sin(angles)).tolist()
    return xs + xs[:1], ys + ys[:1]


@pytest.fixture(scope="module")
def shapes():
    """Concave rings, a third of them copies of one outline."""
    out = []
    for i in range(60):
        xs, ys = star(0.5, 0.5, 0.2, 99) if i % 3 == 0 else star(*np.random.default_rng(i).uniform(0, 1, 2), 0.12, i)
        out.append((i, 0, xs, ys, float(i * 7 % 31)))
    return out


def layer(spark, shapes):
    return spark.createDataFrame(
        shapes, "poly_id long, site_id long, xs array<double>, ys array<double>, measured_height double"
    )


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_point_in_polygon_finds_first_by_layer_order(spark, shapes, hot_rows):
    rng = np.random.default_rng(3)
    pts = [(i, 0, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1, (400, 2)))]
    # A third of the points stand on one spot.
    pts = [(i, s, 0.51, 0.52) if i % 3 == 0 else (i, s, x, y) for i, s, x, y in pts]
    df = spark.createDataFrame(pts, "sample_id long, site_id long, longitude double, latitude double")
    got = spatial.point_in_polygon_join(
        df, layer(spark, shapes), "measured_height", 0.0, bucket=0.05, hot_rows=hot_rows
    ).toPandas().set_index("sample_id")["measured_height"]
    for i, _, x, y in pts:
        inside = [h for _, _, xs, ys, h in shapes if shapely_free_contains(x, y, xs, ys)]
        assert got[i] == (inside[0] if inside else 0.0)


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_footprint_height_and_overlap_match_fine_sampling(spark, shapes, hot_rows):
    rng = np.random.default_rng(5)
    boxes = [(i, 0, float(x), float(y), float(x) + 0.03, float(y) + 0.02) for i, (x, y) in enumerate(rng.uniform(0, 1, (150, 2)))]
    df = spark.createDataFrame(boxes, "sample_id long, site_id long, rx1 double, ry1 double, rx2 double, ry2 double")
    got = spatial.footprint_max_height(df, layer(spark, shapes), ["sample_id"], bucket=0.05, hot_rows=hot_rows)
    got = got.toPandas().set_index("sample_id")["measured_height"]
    for i, _, x1, y1, x2, y2 in boxes:
        grid = [(x1 + (x2 - x1) * a / 24, y1 + (y2 - y1) * b / 24) for a in range(25) for b in range(25)]
        low = [h for _, _, xs, ys, h in shapes if any(shapely_free_contains(x, y, xs, ys) for x, y in grid)]
        # Sampling can only miss contacts, never invent them.
        assert (got[i] >= max(low)) if low else True
        wide = [h for _, _, xs, ys, h in shapes if min(xs) <= x2 and max(xs) >= x1 and min(ys) <= y2 and max(ys) >= y1]
        assert np.isnan(got[i]) or got[i] <= max(wide)


def test_overlap_area_of_a_triangle(spark):
    ring = F.array(*map(F.lit, (0.0, 4.0, 0.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 4.0, 0.0)))
    rect = [F.lit(v) for v in (1.0, 1.0, 5.0, 5.0)]
    assert one(spark, a=geo.ring_rect_overlap(*ring, *rect))["a"] == pytest.approx(2.0)
    whole = [F.lit(v) for v in (-1.0, -1.0, 9.0, 9.0)]
    assert one(spark, a=geo.ring_rect_overlap(*ring, *whole))["a"] == pytest.approx(8.0)


# ---- rasters ------------------------------------------------------------------------------


@pytest.mark.parametrize("hot_rows", [None, 10])
def test_window_maximum_and_majority_across_strips(spark, hot_rows):
    rng = np.random.default_rng(1)
    grid = rng.integers(0, 6, (20, 150)).astype(float)
    grid[rng.uniform(size=grid.shape) < 0.1] = -9999.0
    pixels = spark.createDataFrame(
        [(0, r, c, float(grid[r, c])) for r in range(20) for c in range(150) if (r + c) % 11],
        "site_id long, r int, c int, value double",
    )
    meta = spark.createDataFrame([(0, 0.0, 20.0, 1.0, 1.0, 20, 150, -9999.0)],
                                 "site_id long, x0 double, y0 double, dx double, dy double, nrows int, ncols int, nodata double")
    cells = []
    for i in range(200):
        x, y = rng.uniform(-5, 150), rng.uniform(-3, 20)
        if i % 3 == 0:
            x, y = 60.2, 10.3
        cells.append((i, 0, x, y, x + 8.0, y + 2.5))
    boxes = spark.createDataFrame(cells, "sample_id long, site_id long, rx1 double, ry1 double, rx2 double, ry2 double")
    got = raster.raster_window_max(boxes, pixels, meta, hot_rows=hot_rows).toPandas().set_index("sample_id")["dn"]
    burned = pixels.where("value >= 0").withColumn("type", F.col("value").cast("int"))
    windowed = raster.with_windows(boxes, meta)
    windows = raster.distinct_windows(windowed)
    modes = raster.window_mode(windows, raster.raster_strips(burned, "type", 20))
    mode = raster.on_windows(windowed, modes, "type", windows, hot_rows).toPandas().set_index("sample_id")["type"]
    for i, _, x1, y1, x2, y2 in cells:
        rs, re = np.clip([math.floor(20 - y2), math.ceil(20 - y1 + 1)], 0, 20)
        cs, ce = np.clip([math.floor(x1), math.ceil(x2 + 1)], 0, 150)
        seen = [grid[r, c] for r in range(rs, re) for c in range(cs, ce) if (r + c) % 11]
        valid = [v for v in seen if v != -9999.0]
        assert got[i] == max(valid) if valid else np.isnan(got[i])
        codes = [int(grid[r, c]) if (r + c) % 11 and grid[r, c] >= 0 else 20 for r in range(rs, re) for c in range(cs, ce)]
        if codes:
            assert mode[i] == np.argmax(np.bincount(codes))


# ---- cleaning -----------------------------------------------------------------------------


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_fills_match_pandas_across_blocks(spark, block_rows):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 200), "i": range(200), "v": rng.uniform(0, 9, 200)})
    pdf.loc[rng.uniform(size=200) < 0.6, "v"] = None
    pdf["i"] = pdf.groupby("g").cumcount()
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    line = cleaning.interpolate_linear(df, "v", ["g"], "i", block_rows=block_rows).toPandas()
    last = cleaning.forward_fill(df, "v", ["g"], "i", block_rows=block_rows).toPandas()
    for g, part in pdf.groupby("g"):
        got = line[line["g"] == g].sort_values("i")["v"].to_numpy(float)
        np.testing.assert_allclose(got, part["v"].interpolate(method="linear").to_numpy(), equal_nan=True)
        got = last[last["g"] == g].sort_values("i")["v"].to_numpy(float)
        np.testing.assert_allclose(got, part["v"].ffill().to_numpy(), equal_nan=True)


def test_bins_match_pandas_cut(spark):
    v = np.random.default_rng(4).uniform(-3, 12, 500)
    edges = pd.cut(pd.Series(v), bins=20, retbins=True)[1]
    probe = np.concatenate([v, [-4.0, 13.0, v.min(), v.max()]])
    want = pd.cut(pd.Series(probe), bins=edges, labels=False, include_lowest=True)
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(probe)), "v": probe}))
    lo_hi = cleaning.bin_edges(spark.createDataFrame(pd.DataFrame({"v": v})), {"v": 20})
    got = cleaning.with_bins(df, lo_hi, {"v": 20}).orderBy("i").toPandas()["v_bin"]
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_merge_height_refuses_different_row_counts(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "g int, i int, dn double")
    b = spark.createDataFrame([(0, 0, 1.0)], "g int, i int, measured_height double")
    with pytest.raises(ValueError, match="row counts differ"):
        cleaning.merge_height(a, b, ["g"], "i")


def test_lone_source_keeps_repeats_only_on_request(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert cleaning.dedupe_measurements(df, ["v"]).count() == 1
    assert cleaning.dedupe_measurements(df, ["v"], True, 1).count() == 2


# ---- skew ---------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(900).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    assert hot_keys(left, ["k"], 100).count() == 1
    got = sorted(map(tuple, salted_join(left, right, ["k"], how, hot_rows=100).select("id", "k", "w").collect()), key=str)
    want = sorted(map(tuple, left.join(right, ["k"], how).select("id", "k", "w").collect()), key=str)
    assert got == want


# ---- ensemble and splits ------------------------------------------------------------------


def test_ensemble_stats_match_numpy_even_and_odd(spark):
    rng = np.random.default_rng(6)
    for k in (4, 5):
        names = [f"m{i}" for i in range(k)]
        pdf = pd.DataFrame(rng.normal(size=(50, k)), columns=names)
        got = ensemble.ensemble_stats(spark.createDataFrame(pdf), names).toPandas()
        np.testing.assert_allclose(got["predicted_value"], np.median(got[names], axis=1))
        np.testing.assert_allclose(got["uncertainty"], np.std(got[names].to_numpy(), axis=1))


def test_best_expert_takes_lowest_index_on_tie(spark):
    df = spark.createDataFrame([(0.0, 1.0, -1.0, 2.0)], "rssi double, a double, b double, c double")
    assert ensemble.best_expert(df, ["a", "b", "c"]).first()["best_model_idx"] == 0


def test_splits_are_disjoint_and_cover(spark):
    rows = spark.range(101).select(F.col("id").alias("sample_id"))
    m = splits.expert_splits(rows, "sample_id", 4, 1).toPandas()
    for _, part in m.groupby("expert_id"):
        assert sorted(part["sample_id"]) == list(range(101))
        assert part["is_val"].sum() == math.floor(0.2 * 101)
    twins = rows.withColumn("flipped", F.explode(F.array(F.lit(True), F.lit(False))))
    kept = splits.split_with_twins(twins, 0.2, 3).toPandas()
    assert (kept.groupby("sample_id")["is_test"].nunique() == 1).all()
    leaky = splits.split_with_twins(twins, 0.2, 3, mimic_leak=True).toPandas()
    assert leaky["is_test"].sum() == math.floor(202 * 0.2)


def test_hulls_match_brute_force(spark):
    rng = np.random.default_rng(8)
    pts = [(int(i % 2), float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(400, 2)))]
    pts += [(5, 1.0, 1.0), (5, 1.0, 1.0), (5, 2.0, 2.0)]
    df = spark.createDataFrame(pts, "cluster int, calc_dist double, dn double").repartition(6)
    got = experts.cluster_hulls(df).toPandas()
    for c in (0, 1):
        own = [(x, y) for k, x, y in pts if k == c]
        ring = list(got[got["cluster"] == c].sort_values("vertex")[["px", "py"]].itertuples(index=False, name=None))
        assert set(ring) <= set(own)
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            assert min((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x, y in own) >= -1e-12
    assert len(got[got["cluster"] == 5]) == 2


def test_forest_sizes():
    assert experts.forest_parameters(199)["numTrees"] == 200
    assert experts.forest_parameters(999)["maxDepth"] == 10
    assert experts.forest_parameters(1000)["maxDepth"] == 30
