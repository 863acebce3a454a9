"""Measurement CSV folders in and prediction / feature / model tables out.

A *source* is one entry of the folder: a ``*.csv`` file, or a ``*.csv``
directory as Spark writes it.
"""

from __future__ import annotations

import csv
from collections import Counter, defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlume.session import materialize, shuffle_width

# Required columns and accepted aliases of the upload form.
REQUIRED = ("latitude", "longitude", "rssi")
LON_NAMES = ("longitude", "lon", "lng", "x")
LAT_NAMES = ("latitude", "lat", "y")
RSSI_NAMES = ("rssi", "dn", "predicted_value")
# Fixed value: columns of a raw node log.
LOG_COLUMNS = ("id", "NodeID", "RouteInfo", "DestID", "SendTime", "SeqID", "RecvTime",
               "Latitude", "Longitude", "EncData", "RSSI")

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(nan|inf|infinity)$"
# Tasks a stored dataset is written by.
WRITE_PIECES = 8
# Points of a mesh that one row expands to.
MESH_BLOCK = 1 << 16

_MEASUREMENT = ("longitude", "latitude", "rssi")


def _source_of(path: Column) -> Column:
    """Name of the *.csv entry a file belongs to."""
    return F.regexp_extract(path, r"([^/]+\.csv)(?:/[^/]*)?$", 1)


def _file_source() -> Column:
    """Source of the file a scanned row comes from; the path there is percent-encoded."""
    # url_decode would also turn a plus sign into a blank.
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    return _source_of(path)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(source, path, modified, size) of every file below ``folder`` that is not empty; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select(
            _source_of(F.col("path")).alias("source"), "path", F.col("modificationTime").alias("modified"),
            F.col("length").alias("size"),
        )
    )


def _column_names(line: str) -> tuple[str, ...]:
    """Names in a header line: a missing one counts its place, repeated ones get theirs appended.

    A quote inside quotes is written with a backslash, as in the cells below.
    """
    cells = next(csv.reader([line], escapechar="\\", doublequote=False))
    lower = Counter(c.lower() for c in cells)
    return tuple(
        f"_c{i}" if not c else f"{c}{i}" if lower[c.lower()] > 1 else c for i, c in enumerate(cells)
    )


def _headers(spark: SparkSession, folder: str) -> dict[tuple[str, ...], list[str]]:
    """Distinct headers and the sources that have them, in a fixed number of Spark jobs.

    Tasks take the first line that is not blank of each source's smallest file, so a source
    in many parts is not read for it. A source without such a line has the empty header; one
    of empty files only is not a source. The driver, whose file index names every source
    anyway, gets one line per source.
    """
    files = list_files(spark, folder)
    smallest = F.min(F.struct("size", "path"))["path"]
    chosen = {r["source"]: r["path"] for r in files.groupBy("source").agg(smallest.alias("path")).collect()}
    lines: dict[str, str] = {}
    if chosen:
        # Only a file's first block has its header, and in a task rows are numbered in file order.
        first = (
            spark.read.text(sorted(chosen.values()))
            .where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
            .select(_file_source().alias("source"), "value", F.monotonically_increasing_id().alias("_row"))
            .groupBy("source").agg(F.min_by("value", "_row").alias("line"))
        )
        lines = {r["source"]: r["line"] for r in first.collect()}
    grouped: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for source in sorted(chosen):
        grouped[_column_names(lines[source]) if source in lines else ()].append(source)
    return grouped


def _read_text(spark: SparkSession, folder: str, header: Sequence[str], sources: Sequence[str]) -> DataFrame:
    """All cells as text; only columns used later are parsed."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .csv([f"{folder}/{s}" for s in sources])
    )


def _exact_names(header: Sequence[str]) -> dict[str, str] | None:
    lower = [c.lower() for c in header]
    if not all(name in lower for name in REQUIRED):
        return None
    return {name: header[lower.index(name)] for name in REQUIRED}


def _alias_names(header: Sequence[str]) -> dict[str, str] | None:
    """First column in file order that matches any alias."""

    def first(names: Sequence[str]) -> str | None:
        return next((c for c in header if c.lower() in names), None)

    found = {"longitude": first(LON_NAMES), "latitude": first(LAT_NAMES), "rssi": first(RSSI_NAMES)}
    return None if None in found.values() else found


def _union_matching(
    spark: SparkSession, folder: str, resolve, extra: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Rows (source, text cells) of all readable sources, and the skipped sources.

    Of ``extra`` columns the first of that name in any case is taken, null where absent.
    """
    frames, skipped = [], []
    for header, sources in _headers(spark, folder).items():
        names = resolve(header)
        if names is None:
            skipped += sources
            continue
        raw = _read_text(spark, folder, header, sources)
        also = {c: next((h for h in header if h.lower() == c.lower()), None) for c in extra}
        frames.append(
            raw.select(
                _file_source().alias("source"),
                *[F.col(f"`{names[c]}`").alias(c) for c in _MEASUREMENT],
                *[(F.col(f"`{h}`") if h else F.lit(None).cast("string")).alias(c) for c, h in also.items()],
            )
        )
    if not frames:
        empty = ", ".join(f"`{c}` string" for c in ("source", *_MEASUREMENT, *extra))
        return spark.createDataFrame([], empty), skipped
    return reduce(DataFrame.unionByName, frames), skipped


def _number(c: str) -> Column:
    # The cast alone would also take suffixes such as 5d.
    return F.when(F.lower(F.trim(c)).rlike(_NUMBER), F.expr(f"try_cast(trim({c}) as double)"))


def _numbers(df: DataFrame) -> DataFrame:
    return df.withColumns({c: _number(c) for c in _MEASUREMENT})


def _unreadable(c: str) -> Column:
    """Text that is neither a number nor a usual spelling of a missing value."""
    blank = F.lower(F.trim(c)).isin("", "nan", "null", "na", "n/a", "none")
    return F.col(c).isNotNull() & ~blank & _number(c).isNull()


def read_measurements(
    spark: SparkSession, folder: str, dedupe: bool = True, lone_source_quirk: bool = False,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Union of all CSVs with latitude, longitude and rssi columns in any case.

    A source with text in a needed cell is skipped as a whole; rows with a
    missing value and repeated rows are dropped. With ``lone_source_quirk`` a
    single readable source keeps its repeats. ``extra`` columns come along as text,
    null where a source lacks them.
    """
    rows, _ = _union_matching(spark, folder, _exact_names, extra)
    bad_cell = _unreadable("longitude") | _unreadable("latitude") | _unreadable("rssi")
    broken = materialize(rows.where(bad_cell).select("source").distinct(), "broken-sources")
    kept = _numbers(rows.join(broken, "source", "left_anti")).na.drop(subset=list(_MEASUREMENT))
    kept = kept.select("source", *_MEASUREMENT, *extra)
    if lone_source_quirk and kept.select("source").distinct().limit(2).count() < 2:
        dedupe = False
    out = kept.drop("source")
    return out.dropDuplicates() if dedupe else out


def read_measurements_aliased(spark: SparkSession, folder: str) -> DataFrame:
    """Union of all CSVs under accepted column aliases; incomplete rows dropped, repeats kept."""
    rows, _ = _union_matching(spark, folder, _alias_names)
    return _numbers(rows).na.drop(subset=list(_MEASUREMENT)).select(*_MEASUREMENT)


def ingest_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: merged or why it was skipped, with kept and dropped row counts."""
    rows, skipped = _union_matching(spark, folder, _alias_names)
    numbers = _numbers(rows)
    # The readers drop a cell that says NaN like a missing one.
    complete = F.lit(True)
    for c in _MEASUREMENT:
        complete = complete & F.col(c).isNotNull() & ~F.isnan(c)
    counts = numbers.groupBy("source").agg(
        F.count_if(complete).alias("rows_kept"), F.count_if(~complete).alias("rows_dropped")
    )
    merged = counts.withColumn(
        "status", F.when(F.col("rows_kept") > 0, "merged").otherwise("skipped: no valid rows")
    )
    if not skipped:
        return merged
    zero = F.lit(0).cast("long")
    unknown = spark.createDataFrame([(s,) for s in skipped], "source string").select(
        "source", zero.alias("rows_kept"), zero.alias("rows_dropped"),
        F.lit("skipped: columns not found").alias("status"),
    )
    return merged.unionByName(unknown)


def read_latest_prediction(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Rows of the newest ``predict_rss_*`` table in the folder."""
    newest = (
        list_files(spark, folder)
        .where(F.col("source").startswith("predict_rss_"))
        .groupBy("source")
        .agg(F.max("modified").alias("modified"))
        .orderBy(F.desc("modified"), F.desc("source"))
        .first()
    )
    if newest is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(f"{folder}/{newest['source']}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_prediction(df: DataFrame, folder: str, stamp: str) -> str:
    """One ``predict_rss_<stamp>.csv`` table, written by all tasks."""
    path = f"{folder}/predict_rss_{stamp}.csv"
    write_csv(df, path)
    return path


def write_features(df: DataFrame, folder: str) -> None:
    """Stored feature sets, one directory per dataset so that reads can skip the others.

    A dataset written again replaces what was stored of it; others stay. A dataset
    of any size is dealt over several tasks, and each task has few datasets.
    """
    deal = F.pmod(F.xxhash64(*df.columns), F.lit(WRITE_PIECES))
    (
        df.repartition("dataset_id", deal)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset_id").parquet(folder)
    )


def read_feature_sets(spark: SparkSession, folder: str, ids: Sequence[int]) -> DataFrame:
    """Chosen feature sets; power and frequency stay those of each row's own dataset."""
    return spark.read.parquet(folder).where(F.col("dataset_id").isin(*ids))


def write_ensemble(
    experts: Sequence, folder: str, spark: SparkSession, judge=None, linear: DataFrame | None = None,
    held_out: DataFrame | None = None, **facts,
) -> None:
    """Expert models plus a table saying which stage of which expert lies where.

    A fitted judge, the linear experts' results and the held-out rows go along.
    """
    if judge is not None:
        judge.save(f"{folder}/judge")
    for name, rows in (("linear", linear), ("held_out", held_out)):
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    parts = [n for n, x in (("judge", judge), ("linear", linear), ("held_out", held_out)) if x is not None]
    facts = facts | {"parts": ",".join(parts)}
    rows = []
    for e, expert in enumerate(experts):
        for s, model in enumerate(expert.stages):
            path = f"{folder}/expert={e}/stage={s}"
            model.write().overwrite().save(path)
            rows.append((e, s, path, type(model).__name__, {k: str(v) for k, v in facts.items()}))
    schema = "expert_id int, stage int, path string, kind string, facts map<string,string>"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/metadata")


def read_bundle(spark: SparkSession, folder: str) -> dict:
    """All that ``write_ensemble`` stored: experts, facts, judge, linear and held_out (None if absent)."""
    from airlume.operators.forest import Forest

    facts = spark.read.parquet(f"{folder}/metadata").select("facts").first()["facts"]
    parts = facts.get("parts", "").split(",")
    read = lambda n: spark.read.parquet(f"{folder}/{n}") if n in parts else None
    return {
        "experts": read_ensemble(spark, folder), "facts": facts,
        "judge": Forest.load(spark, f"{folder}/judge") if "judge" in parts else None,
        "linear": read("linear"), "held_out": read("held_out"),
    }


def read_ensemble(spark: SparkSession, folder: str) -> list:
    from pyspark.ml.regression import GBTRegressionModel

    from airlume.operators.experts import Expert

    stages: dict[int, list] = defaultdict(list)
    for row in spark.read.parquet(f"{folder}/metadata").orderBy("expert_id", "stage").collect():
        stages[row["expert_id"]].append(GBTRegressionModel.load(row["path"]))
    return [Expert(stages[e]) for e in sorted(stages)]


def grid_points(areas: DataFrame, block: int = MESH_BLOCK) -> DataFrame:
    """n x m mesh per area, both ends included, latitude in the outer loop.

    ``areas``: area_id, lon_min, lon_max, lat_min, lat_max, n, m. A box without
    extent gives one point; an area without lines or columns, or of unknown size,
    gives none. Emits the raw-log columns with an impossible RSSI. Points are made
    in blocks of ``block``, dealt evenly over all tasks, so an area of any size is
    no single task's work.
    """
    one = (F.col("lon_min") == F.col("lon_max")) & (F.col("lat_min") == F.col("lat_max"))
    sized = areas.withColumns(
        {"_n": F.when(one, 1).otherwise(F.col("n")), "_m": F.when(one, 1).otherwise(F.col("m"))}
    )
    n, m = F.col("_n"), F.col("_m")
    lon_step = F.when(n > 1, (F.col("lon_max") - F.col("lon_min")) / (n - 1)).otherwise(0.0)
    lat_step = F.when(m > 1, (F.col("lat_max") - F.col("lat_min")) / (m - 1)).otherwise(0.0)
    points = n.cast("long") * m
    first = F.col("_block") * F.lit(block)
    blocks = (
        sized.withColumns({"_dx": lon_step, "_dy": lat_step, "_points": points})
        .where((n > 0) & (m > 0))
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_points") - 1) / block))))
        .repartition(shuffle_width(areas.sparkSession))
    )
    mesh = blocks.withColumn(
        "_point", F.explode(F.sequence(first, F.least(first + F.lit(block), F.col("_points")) - 1))
    ).withColumns({"_i": (F.col("_point") - F.col("_point") % n) / n, "_j": F.col("_point") % n})
    zero = F.lit(0)
    values = {
        "Latitude": F.col("lat_min") + F.col("_i") * F.col("_dy"),
        "Longitude": F.col("lon_min") + F.col("_j") * F.col("_dx"),
        "RSSI": F.lit(-999),
    }
    return mesh.select(
        "area_id", F.col("_point").alias("point_idx"),
        *[values.get(c, zero).alias(c) for c in LOG_COLUMNS],
    )


def nearfield_points(benches: DataFrame, readings: str = "rssi_list") -> DataFrame:
    """One row per reading at the fixed place of a bench."""
    return benches.select(
        "bench_id", "site_id", "longitude", "latitude", F.posexplode(readings).alias("reading", "rssi")
    )
