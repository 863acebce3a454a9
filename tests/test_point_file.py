from __future__ import annotations

from airlume.sources.files import read_measurements


def test_extra_columns_come_along_as_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Latitude,SITE_ID,Longitude,RSSI\n1.5,7,2.5,-80\n1.5,7,2.5,-80\n1.5,8,2.5,-80\n,9,1,1\n")
    (tmp_path / "b.csv").write_text("longitude,latitude,rssi\n3,4,-90\n")
    (tmp_path / "c.csv").write_text("site_id,latitude\n1,2\n")
    rows = read_measurements(spark, str(tmp_path), extra=("site_id",)).collect()
    got = {(r.longitude, r.latitude, r.rssi, r.site_id) for r in rows}
    assert got == {(2.5, 1.5, -80.0, "7"), (2.5, 1.5, -80.0, "8"), (3.0, 4.0, -90.0, None)}
    assert len(rows) == 3
    plain = read_measurements(spark, str(tmp_path))
    assert plain.columns == ["longitude", "latitude", "rssi"] and plain.count() == 2


def test_extra_columns_of_no_readable_file(spark, tmp_path):
    (tmp_path / "c.csv").write_text("site_id,latitude\n1,2\n")
    rows = read_measurements(spark, str(tmp_path), extra=("site_id",))
    assert rows.columns == ["longitude", "latitude", "rssi", "site_id"] and rows.count() == 0
