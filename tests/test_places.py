"""Readings at one position share its map samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlume.operators import experts, links
from airlume.plans import jobs

SITE = "site_id long, tx_lon double, tx_lat double, tx_alt double, tx_ant_h double, rx_ant_h double, freq_mhz double, pt_dbm double"


def _sites(spark):
    return spark.createDataFrame([(1, 133.0, 33.0, 100.0, 2.0, 1.8, 920.0, 37.0), (2, 134.0, 33.0, 90.0, 2.0, 1.8, 220.0, 37.0)], SITE)


def _points(spark, repeats: int):
    """Readings of four positions, two of them alike but for the site."""
    at = [(1, 133.003, 33.001), (2, 133.003, 33.001), (2, 134.002, 33.002), (1, 132.998, 33.004)]
    rows = [(f"{k:02}-{i}", *p, -60.0 - k - i) for i, p in enumerate(at) for k in range(repeats)]
    return spark.createDataFrame(rows, "sample_id string, site_id long, longitude double, latitude double, rssi double")


def _pixels(spark):
    meta = spark.sql("select site_id, 132.9 + (site_id - 1) x0, 33.1 y0, 0.01 dx, 0.01 dy, 20 nrows, 20 ncols from values 1L, 2L t(site_id)")
    cells = spark.sql("""select site_id, cast(r as int) r, cast(c as int) c,
        case when (r + c) % 3 = 0 then -9999d else cast(r * 7 + c as double) end value
        from values 1L, 2L t(site_id), range(20) a(r), range(20) b(c)""")  # fmt: skip
    return cells, meta.withColumns({c: F.col(c).cast("double") for c in ("x0", "y0", "dx", "dy")})


def test_cells_are_sampled_once_a_position(spark, monkeypatch):
    seen, sample = [], links.sample_cells

    def counted(rows, *layers):
        seen.append(rows.count())
        return sample(rows, *layers)

    monkeypatch.setattr(links, "sample_cells", counted)
    points, (cells, meta) = _points(spark, 3), _pixels(spark)
    many = {r["sample_id"]: r for r in links.build_features(points, _sites(spark), None, cells, meta, None).collect()}
    assert seen == [4] and len(many) == 12
    once = points.where("sample_id like '02-%'")
    alone = links.build_features(once, _sites(spark), None, cells, meta, None).collect()
    for row in alone:
        assert row == many[row["sample_id"]]
        assert many["00" + row["sample_id"][2:]]["height"] == row["height"]
        assert abs(many["00" + row["sample_id"][2:]]["target_db"] - row["target_db"] - 2) < 1e-9


def test_model_input_is_that_of_the_features(spark):
    points, (cells, meta) = _points(spark, 2), _pixels(spark)
    maps = jobs.Maps(_sites(spark), None, cells, meta, None)
    want = experts.with_model_input(links.augment_flip(maps.features(points))).drop(*jobs.ARRAYS)
    got = maps.model_input(points, twins=True)
    rows = lambda df: {(r["sample_id"], r["flipped"]): r for r in df.select(*sorted(df.columns)).collect()}
    assert len(rows(got)) == 16 and rows(got) == rows(want)
