from __future__ import annotations

import pytest

from airlume.sources import files


def _folder(path, n):
    path.mkdir()
    for i in range(n):
        head = "latitude,longitude,rssi" if i % 2 else "RSSI,Longitude,Latitude"
        (path / f"f{i:04}.csv").write_text(f"{head}\n{i}.0,2.0,{i}.0\n")
    return str(path)


def _jobs(spark, label, folder):
    context = spark.sparkContext
    context.setJobGroup(label, label)
    try:
        found = files._headers(spark, folder)
        return found, len(context.statusTracker().getJobIdsForGroup(label))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_follow_the_number_of_files(spark, tmp_path):
    few, jobs_few = _jobs(spark, "few", _folder(tmp_path / "few", 40))
    many, jobs_many = _jobs(spark, "many", _folder(tmp_path / "many", 1200))
    assert jobs_many == jobs_few <= 6
    assert {h: len(s) for h, s in many.items()} == {
        ("latitude", "longitude", "rssi"): 600, ("RSSI", "Longitude", "Latitude"): 600,
    }
    assert sum(len(s) for s in few.values()) == 40


def test_rows_of_many_small_files(spark, tmp_path):
    got = files.read_measurements(spark, _folder(tmp_path / "all", 101)).collect()
    assert sorted(tuple(r) for r in got) == sorted((2.0, float(i), float(i)) for i in range(101))


HEADERS = {
    "plain.csv": "latitude,longitude,rssi\n1,2,3\n",
    "blank lines.csv": "\n  \nlatitude,longitude,rssi\n1,2,4\n",
    "quoted+1.csv": '"Latitude","a \\"b\\", c",Longitude,RSSI\n1,x,2,5\n',
    "twice.csv": "rssi,RSSI,latitude,longitude\n1,1,1,1\n",
    "gap.csv": "latitude,,longitude,rssi\n1,9,2,6\n",
    "none.csv": "",
    "only blanks.csv": "\n\n",
    "crlf.csv": "latitude,longitude,rssi\r\n1,2,7\r\n",
}


@pytest.fixture
def mixed(tmp_path):
    for name, text in HEADERS.items():
        (tmp_path / name).write_bytes(text.encode())
    parts = tmp_path / "parts.csv"
    parts.mkdir()
    (parts / "part-0.csv").write_text("")
    (parts / "part-1.csv").write_text("latitude,longitude,rssi\n" + "1,2,8\n" * 50)
    (parts / "part-2.csv").write_text("latitude,longitude,rssi\n1,2,9\n")
    return tmp_path


def test_names_equal_those_of_the_reader(spark, mixed):
    for header, sources in files._headers(spark, str(mixed)).items():
        for source in sources:
            want = spark.read.option("header", True).csv(str(mixed / source)).columns
            assert list(header) == want, source


def test_report_of_unusual_files(spark, mixed):
    got = {r.source: (r.rows_kept, r.rows_dropped, r.status) for r in files.ingest_report(spark, str(mixed)).collect()}
    absent = (0, 0, "skipped: columns not found")
    one = (1, 0, "merged")
    assert got == {
        "plain.csv": one, "blank lines.csv": one, "quoted+1.csv": one, "gap.csv": one, "crlf.csv": one,
        "twice.csv": absent, "only blanks.csv": absent, "parts.csv": (51, 0, "merged"),
    }


def test_text_in_a_cell_skips_a_source_with_blanks_in_its_name(spark, tmp_path):
    (tmp_path / "bad one.csv").write_text("latitude,longitude,rssi\n1,2,x\n1,2,3\n")
    (tmp_path / "good one.csv").write_text("latitude,longitude,rssi\n5,6,7\n")
    rows = files.read_measurements(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [(6.0, 5.0, 7.0)]


def test_empty_folder_has_no_headers(spark, tmp_path):
    assert files._headers(spark, str(tmp_path)) == {}
