"""Splits, linear and nonlinear experts, judge, clusters and jobs with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlume.functions import geometry as geo
from airlume.operators import ensemble, experts, linear, splits
from airlume.operators.skew import salted_join
from airlume.plans import jobs, parts
from airlume.plans.geometry_queries import pixels, r
from airlume.plans.ingest_queries import benches, predictions
from airlume.plans.registry import PARTS, query, rd
from airlume.session import materialize, new_folder
from airlume.sources import files
from airlume.sources.derived import MODEL_COLUMNS, polygons, table

K = 5
SEED = jobs.SEED


def linear_rows(spark: SparkSession, sf: str) -> DataFrame:
    freq = F.when(F.col("band") == "220", 220.0).otherwise(920.0)
    return table(spark, sf, "predictions").select(
        "sample_id", "band", "rssi", "distance_m", "dn", freq.alias("freq_mhz")
    )


PARTS["linear_rows"] = """
    select sample_id, band, rssi, distance_m, dn, case when band = '220' then 220e0 else 920e0 end freq_mhz
    from {predictions}"""
PARTS["permuted"] = f"""
    select *, row_number() over (order by md5('{SEED}-' || sample_id), sample_id) position, count(*) over () n
    from {{linear_rows}}"""
PARTS["tested"] = "select *, position <= floor(n * 0.15e0) is_test from {permuted}"
_MEMBERS = f"""
    select sample_id, expert_id, rn <= floor(0.2e0 * n) is_val
    from (select sample_id, expert_id, count(*) over (partition by expert_id) n,
                 row_number() over (partition by expert_id order by md5('{SEED}-' || expert_id || '-' || sample_id), sample_id) rn
          from (select sample_id, cast(e as int) expert_id from {{%s}}, range(0, {K}) t(e) %s) a) b"""
PARTS["members"] = _MEMBERS % ("tested", "where not is_test")
PARTS["all_members"] = _MEMBERS % ("linear_rows", "")


def _trained_on(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    tested = splits.test_split(linear_rows(spark, sf), "sample_id", jobs.GENERAL_TEST_SHARE, SEED)
    return tested.where("not is_test"), tested.where("is_test")


@query("shuffle_rows", "select sample_id, position from {permuted}")
def _shuffle_rows(spark: SparkSession, sf: str) -> DataFrame:
    return splits.shuffle_rows(linear_rows(spark, sf), "sample_id", SEED).select("sample_id", "position")


@query("test_split", "select sample_id, is_test from {tested}")
def _test_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = linear_rows(spark, sf)
    return splits.test_split(rows, "sample_id", jobs.GENERAL_TEST_SHARE, SEED).select("sample_id", "is_test")


@query("expert_splits", "select sample_id, expert_id, is_val from {members}")
def _expert_splits(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _trained_on(spark, sf)
    return splits.expert_splits(train, "sample_id", K, SEED)


@query("holdout_complement", "select sample_id, expert_id from {members} where not is_val")
def _holdout_complement(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _trained_on(spark, sf)
    members = splits.expert_splits(train, "sample_id", K, SEED)
    everyone = linear.with_experts(train.select("sample_id"), K)
    return splits.holdout_complement(everyone, members.where("is_val"), ["sample_id", "expert_id"])


@query("union_datasets", f"""
    select 'sites' dataset, sample_id, {rd('rssi')} rssi from {{measurements}}
    union all select 'log', record_id, {rd('rssi')} from {{field_log}}
    union all select 'bands', sample_id, {rd('rssi')} from {{predictions}}""")
def _union_datasets(spark: SparkSession, sf: str) -> DataFrame:
    def tagged(name: str, source: str, key: str) -> DataFrame:
        return table(spark, sf, source).select(
            F.lit(name).alias("dataset"), F.col(key).alias("sample_id"), r("rssi").alias("rssi")
        )

    return splits.union_datasets(
        tagged("sites", "measurements", "sample_id"), tagged("log", "field_log", "record_id"),
        tagged("bands", "predictions", "sample_id"),
    )


@query("replicate_small", """
    select sample_id, site_id, cast(i as int) copy
    from {measurements}, range(1, 1 + (select cast(ceil(200e0 / count(*)) as bigint) from {measurements})) t(i)""")
def _replicate_small(spark: SparkSession, sf: str) -> DataFrame:
    return splits.replicate_small(table(spark, sf, "measurements")).select("sample_id", "site_id", "copy")


# ---- linear experts -----------------------------------------------------------------------

_OLS = """
    select {keys}, b1 c_dist, b2 c_freq, my - b1 * m1 - b2 * m2 c0
    from (select *, (v22 * c1 - v12 * c2) / (v11 * v22 - v12 * v12) b1, (v11 * c2 - v12 * c1) / (v11 * v22 - v12 * v12) b2
          from (select {keys}, var_pop(log10(distance_m)) v11, var_pop(log10(freq_mhz)) v22,
                       covar_pop(log10(distance_m), log10(freq_mhz)) v12, covar_pop(log10(distance_m), rssi) c1,
                       covar_pop(log10(freq_mhz), rssi) c2, avg(log10(distance_m)) m1, avg(log10(freq_mhz)) m2, avg(rssi) my
                from {rows} group by {keys}) a) b"""
PARTS["own_rows"] = """
    select t.*, m.expert_id from {tested} t join {members} m on m.sample_id = t.sample_id where not m.is_val"""
PARTS["coefficients"] = _OLS.replace("{keys}", "expert_id").replace("{rows}", "{own_rows}")


@query("ols_log_distance", f"""
    select expert_id, {rd('c_dist')} c_dist, {rd('c_freq')} c_freq, {rd('c0')} c0 from {{coefficients}}""")
def _ols_log_distance(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _trained_on(spark, sf)
    members = splits.expert_splits(train, "sample_id", K, SEED).where("not is_val")
    fitted = linear.ols_log_distance(train.join(members, "sample_id"))
    return fitted.select("expert_id", r("c_dist").alias("c_dist"), r("c_freq").alias("c_freq"), r("c0").alias("c0"))


_PRED = "c_dist * log10(distance_m) + c_freq * log10(freq_mhz) + c0"


@query("linear_experts", f"""
    select t.sample_id, c.expert_id, {rd(_PRED)} pred from {{tested}} t, {{coefficients}} c where t.is_test""")
def _linear_experts(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _trained_on(spark, sf)
    members = splits.expert_splits(train, "sample_id", K, SEED)
    return linear.linear_experts(train, members, test, K).select("sample_id", "expert_id", r("pred").alias("pred"))


PARTS["folds"] = "select *, cast(position % 5 as int) fold from {permuted}"
PARTS["fold_rows"] = """
    select f.*, m.expert_id, cast(o.i as int) left_out
    from {folds} f join {all_members} m on m.sample_id = f.sample_id and not m.is_val
    join range(0, 5) o(i) on o.i <> f.fold"""
PARTS["fold_coefficients"] = _OLS.replace("{keys}", "expert_id, left_out").replace("{rows}", "{fold_rows}")
PARTS["oof"] = f"""
    select f.sample_id, f.rssi, f.distance_m, f.dn, c.expert_id, {_PRED} pred
    from {{folds}} f join {{fold_coefficients}} c on c.left_out = f.fold"""


def _folded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = linear_rows(spark, sf)
    return splits.fold_of(rows, "sample_id", 5, SEED), splits.expert_splits(rows, "sample_id", K, SEED)


def oof_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold predictions of the linear experts over all rows, long form."""
    return linear.kfold_oof_linear(*_folded(spark, sf), K)


@query("kfold_oof", f"select sample_id, expert_id, {rd('pred')} pred from {{oof}}")
def kfold_oof(spark: SparkSession, sf: str) -> DataFrame:
    return oof_linear(spark, sf).select("sample_id", "expert_id", r("pred").alias("pred"))


_PIVOT = ", ".join(f"max(case when expert_id = {i} then round(pred, 6) end) model_{i}" for i in range(K))
_OFF = ", ".join(f"abs(model_{i} - rssi_tv)" for i in range(K))
PARTS["report"] = f"""
    select *, abs(median_prediction - rssi_tv) median_abs_error, list_min([{_OFF}]) best_model_error,
           cast(list_position([{_OFF}], list_min([{_OFF}])) - 1 as int) best_model_idx
    from (select *, list_sort([{', '.join(MODEL_COLUMNS)}])[3] median_prediction
          from (select sample_id, any_value(rssi) rssi_tv, any_value(distance_m) distance_m, any_value(dn) dn, {_PIVOT}
                from {{oof}} group by sample_id) a) b"""
PARTS["all_models"] = """
    select 'linear' model, sample_id, pred, rssi from {oof}
    union all
    select 'ensemble', sample_id, unnest([model_0, model_1, model_2, model_3, model_4]), rssi from {predictions}"""
_REPORT_NUMBERS = ("rssi_tv", *MODEL_COLUMNS, "median_prediction", "median_abs_error", "best_model_error")
_REPORT_SQL = f"""
    select sample_id, best_model_idx, distance_m, dn, {', '.join(f'{rd(c, 6)} {c}' for c in _REPORT_NUMBERS)} from {{report}}"""


def oof_report(spark: SparkSession, sf: str) -> DataFrame:
    wide = linear.kfold_oof_wide(*_folded(spark, sf), K).select(
        "sample_id", F.col("rssi").alias("rssi_tv"), *[F.round(c, 6).alias(c) for c in MODEL_COLUMNS]
    )
    receivers = linear_rows(spark, sf).select("sample_id", "distance_m", "dn")
    return ensemble.oof_report(wide, MODEL_COLUMNS, receivers)


def _report_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "sample_id", "best_model_idx", "distance_m", "dn", *[r(c, 6).alias(c) for c in _REPORT_NUMBERS]
    )


@query("oof_report", _REPORT_SQL)
def _oof_report(spark: SparkSession, sf: str) -> DataFrame:
    return _report_columns(oof_report(spark, sf))


@query("write_oof_report", _REPORT_SQL)
def _write_oof_report(spark: SparkSession, sf: str) -> DataFrame:
    report, path = oof_report(spark, sf), new_folder(spark, "oof")
    files.write_csv(report, path)
    return _report_columns(spark.read.schema(report.schema).option("header", True).csv(path))


# ---- mixture ------------------------------------------------------------------------------

PARTS["top_groups"] = """
    select sample_id, group_id, p / sum(p) over (partition by sample_id) p, k
    from (select *, row_number() over (partition by sample_id order by p desc, group_id desc) k from {group_probs}) q
    where k <= %d"""
PARTS["top_one"] = PARTS["top_groups"] % 1
PARTS["top_groups"] = PARTS["top_groups"] % 2


@query("top_g_groups", f"select sample_id, group_id, cast(k as int) rank, {rd('p', 9)} p from {{top_groups}}")
def _top_g_groups(spark: SparkSession, sf: str) -> DataFrame:
    return ensemble.top_g_groups(table(spark, sf, "group_probs"), 2).select(
        "sample_id", "group_id", "rank", r("p", 9).alias("p")
    )


# Many mixtures end exactly on a rounding edge; this shift moves them off it.
_OFF_EDGE = 0.0000033


def _moe_sql(part: str, g: int) -> str:
    return f"""
    select {g} g, t.sample_id, {rd(f'sum(t.p * m.med) + {_OFF_EDGE:.7f}')} moe
    from {{{part}}} t join (
        select e.sample_id, g.group_id, quantile_cont(e.pred, 0.5) med
        from (select sample_id, unnest([0, 1, 2, 3, 4]) expert_id,
                     unnest([model_0, model_1, model_2, model_3, model_4]) pred from {{predictions}}) e
        join {{expert_groups}} g on g.expert_id = e.expert_id group by 1, 2) m
      on m.sample_id = t.sample_id and m.group_id = t.group_id
    group by t.sample_id"""


@query("mixture_of_experts", _moe_sql("top_one", 1) + "\nunion all\n" + _moe_sql("top_groups", 2))
def _mixture_of_experts(spark: SparkSession, sf: str) -> DataFrame:
    rows, probs, groups = (table(spark, sf, t) for t in ("predictions", "group_probs", "expert_groups"))
    mixed = [
        ensemble.mixture_of_experts(rows, MODEL_COLUMNS, probs, groups, g).select(
            F.lit(g).alias("g"), "sample_id", r(F.col("moe") + _OFF_EDGE).alias("moe")
        )
        for g in (1, 2)
    ]
    return splits.union_datasets(*mixed)


# ---- evaluation of kinds of models --------------------------------------------------------


@query("job_evaluate", f"""
    select model, {rd('error', 6)} error,
           {rd('row_number() over (partition by model order by error) / count(*) over (partition by model)', 9)} cdf
    from (select model, round(abs(quantile_cont(pred, 0.5) - any_value(rssi)), 9) error from {{all_models}} group by model, sample_id
          union all select model || '_oracle', round(min(abs(pred - rssi)), 9) from {{all_models}} group by model, sample_id) q""")
def _job_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    """Linear experts out of fold against the stored ensemble."""
    own = oof_linear(spark, sf).select(F.lit("linear").alias("model"), "sample_id", "expert_id", "pred", "rssi")
    stored = ensemble.to_long(table(spark, sf, "predictions"), MODEL_COLUMNS, "sample_id", "rssi").select(
        F.lit("ensemble").alias("model"), "sample_id", "expert_id", "pred", "rssi"
    )
    cdf = jobs.evaluate(own.unionByName(stored))
    return cdf.select("model", r("error", 6).alias("error"), r("cdf", 9).alias("cdf"))


# ---- nonlinear experts: ids, and facts that hold for any fit ------------------------------
#
# SQL cannot say what a boosted tree predicts. These queries run the whole fit and show what it
# must give whatever the trees are: the rows, and whether the predictions keep to a known rule.


def model_rows(spark: SparkSession, sf: str, twins: bool = False) -> DataFrame:
    """Model input of every measurement's path on the maps, and as target what the reading has over free space.

    With ``twins`` also every link as seen from the other end, and a ``row_id``.
    """
    rows = _maps(spark, sf).model_input(table(spark, sf, "measurements"), twins)
    return materialize(rows.withColumn("row_id", jobs.row_id()) if twins else rows, "model-rows")


_MODELS = [f"model_{i}" for i in range(K)]


def _middle() -> Column:
    """Median of the experts, by sorting."""
    return F.sort_array(F.array(*_MODELS))[K // 2]


def _members(rows: DataFrame, key: str = "sample_id") -> DataFrame:
    return splits.expert_splits(rows.select(key), key, K, SEED)


def _error(df: DataFrame, truth: str = "target_db", guess: Column | None = None) -> float:
    """Mean absolute error of the experts' median, or of another guess."""
    return df.agg(F.avg(F.abs((_middle() if guess is None else guess) - F.col(truth)))).first()[0]


def _mean_error(rows: DataFrame) -> float:
    """Mean absolute error of guessing the mean target everywhere."""
    return _error(rows, guess=F.lit(rows.agg(F.avg("target_db")).first()[0]))


def _close(a: Column, b: Column, by: float = 1e-9) -> Column:
    return F.abs(a - b) < by


@query("train_experts", "select sample_id, site_id, true learned from {links}")
def _train_experts(spark: SparkSession, sf: str) -> DataFrame:
    """learned: over all rows the experts err less than the mean target does."""
    twins = model_rows(spark, sf, twins=True)
    fits, rows = experts.train_experts(twins, _members(twins, "row_id"), K, key="row_id"), twins.where("not flipped")
    out = materialize(experts.predict_experts(fits, rows), "predicted")
    return out.select("sample_id", "site_id", F.lit(_error(out) < _mean_error(rows)).alias("learned"))


def _old_and_new(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites of the southern half are the old ones."""
    return rows.where("site_id < 13"), rows.where("site_id >= 13")


@query("fine_tune_experts", "select sample_id, site_id, true improved, true base_kept from {links}")
def _fine_tune_experts(spark: SparkSession, sf: str) -> DataFrame:
    """improved: tuned experts err less on the new sites than their base; base_kept: it predicts as before."""
    twins = model_rows(spark, sf, twins=True)
    (old, new), rows = _old_and_new(twins), twins.where("not flipped")
    base = experts.train_experts(old, _members(old, "row_id"), K, key="row_id")
    before = materialize(experts.predict_experts(base, rows), "base")
    tuned = experts.fine_tune_experts(base, new, _members(new, "row_id"), key="row_id")
    out = materialize(experts.predict_experts(tuned, rows), "tuned")
    again = experts.predict_experts(base, rows).select("sample_id", _middle().alias("_again"))
    kept = before.select("sample_id", _middle().alias("_first")).join(again, "sample_id")
    same = kept.where(~F.col("_first").eqNullSafe(F.col("_again"))).isEmpty()
    better = _error(out.where("site_id >= 13")) < _error(before.where("site_id >= 13"))
    return out.select("sample_id", "site_id", F.lit(better).alias("improved"), F.lit(same).alias("base_kept"))


@query("incremental_experts", "select sample_id, site_id, true learned from {links}")
def _incremental_experts(spark: SparkSession, sf: str) -> DataFrame:
    """learned: over old and new rows the experts err less than the mean target does."""
    twins = model_rows(spark, sf, twins=True)
    (old, new), rows = _old_and_new(twins), twins.where("not flipped")
    fits = experts.incremental_experts(old, new, _members(twins, "row_id"), K, key="row_id")
    out = materialize(experts.predict_experts(fits, rows), "predicted")
    return out.select("sample_id", "site_id", F.lit(_error(out) < _mean_error(rows)).alias("learned"))


def _deviation() -> Column:
    mean = sum((F.col(m) for m in _MODELS), F.lit(0.0)) / K
    return F.sqrt(sum((F.pow(F.col(m) - mean, 2) for m in _MODELS), F.lit(0.0)) / K)


@query("predict_ensemble", f"""
    select sample_id, {rd(parts.loss(2))} path_loss_eta_2, {rd(parts.loss(3))} path_loss_eta_3, true is_median,
           true is_spread
    from {{links}}""")
def _predict_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """is_median, is_spread: value and uncertainty are the experts' median and deviation."""
    rows = model_rows(spark, sf)
    fits = experts.train_experts(rows, _members(rows), K)
    return jobs.predict(fits, rows).select(
        "sample_id", r("path_loss_eta_2").alias("path_loss_eta_2"), r("path_loss_eta_3").alias("path_loss_eta_3"),
        _close(F.col("predicted_value"), _middle()).alias("is_median"),
        _close(F.col("uncertainty"), _deviation(), 1e-6).alias("is_spread"),
    )


def _same_models(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, same): whether both predict exactly the same for a row."""
    renamed = b.select(key, *[F.col(m).alias(f"_{m}") for m in _MODELS])
    same = reduce(Column.__and__, [F.col(m).eqNullSafe(F.col(f"_{m}")) for m in _MODELS])
    return a.join(renamed, key).select(key, (same & _middle().isNotNull()).alias("same"))


@query("write_ensemble", "select sample_id, true same from {links}")
def _write_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """same: experts read back predict exactly what the fitted ones do."""
    rows, folder = model_rows(spark, sf), new_folder(spark, "ensemble")
    fits = experts.train_experts(rows, _members(rows), K)
    files.write_ensemble(fits, folder, spark, n_experts=K, channels="height,slope,landuse,freq,step")
    stored = files.read_ensemble(spark, folder)
    return _same_models(
        experts.predict_experts(fits, rows), experts.predict_experts(stored, rows), "sample_id"
    )


@query("judge_residual_forest", f"""
    select sample_id, true in_range
    from (select sample_id, row_number() over (order by md5('{SEED}-' || sample_id), sample_id) position from {{links}}) q
    where position % {K} = 0""")
def _judge_residual_forest(spark: SparkSession, sf: str) -> DataFrame:
    """The judge on a fold it was not fitted on.

    in_range: a forest averages what it saw, so its shift lies between the least and
    the greatest residual of the other folds.
    """
    rows = splits.fold_of(model_rows(spark, sf), "sample_id", K, SEED)
    oof = experts.kfold_oof(materialize(rows, "folds"), _members(rows), K)
    judged = materialize(
        ensemble.ensemble_stats(oof, _MODELS).withColumn("median_prediction", F.col("predicted_value")), "oof"
    )
    train, held_out = judged.where("fold <> 0"), judged.where("fold = 0")
    residual = F.col("target_db") - F.col("median_prediction")
    low, high = train.agg(F.min(residual), F.max(residual)).first()
    shift = F.col("predicted_value_judge") - F.col("predicted_value")
    out = experts.judge_residual_forest(train, held_out, "target_db")
    return out.select("sample_id", shift.between(low - 1e-9, high + 1e-9).alias("in_range"))


CLUSTERS, BAD_ERROR = 3, 4.79
PARTS["bad_points"] = f"""
    select *, 2 * atan2(sqrt(a), sqrt(1 - a)) * 6371.0088e0 * 1000 calc_dist
    from (select *, power(sin(radians(33e0 - latitude) / 2), 2)
             + cos(radians(latitude)) * cos(radians(33e0)) * power(sin(radians(133e0 - longitude) / 2), 2) a
          from {{stats}} where abs_error > {BAD_ERROR}e0) q"""


def _clustered(spark: SparkSession, sf: str) -> DataFrame:
    d = geo.haversine(F.col("longitude"), F.col("latitude"), F.lit(133.0), F.lit(33.0))
    return experts.cluster_bad_points(predictions(spark, sf).withColumn("calc_dist", d), CLUSTERS, BAD_ERROR)


@query("cluster_bad_points", f"""
    select sample_id, {rd('calc_dist')} calc_dist, {rd('dn')} dn, {rd('abs_error')} abs_error, true in_range
    from {{bad_points}}""")
def _cluster_bad_points(spark: SparkSession, sf: str) -> DataFrame:
    """in_range: every bad point is in one of the clusters."""
    return _clustered(spark, sf).select(
        "sample_id", *[r(c).alias(c) for c in ("calc_dist", "dn", "abs_error")],
        F.col("cluster").between(0, CLUSTERS - 1).alias("in_range"),
    )


@query("cluster_summary", f"""
    select cast({CLUSTERS} as bigint) clusters, count(*) n, {rd('max(abs_error)', 6)} max_error, {rd('avg(calc_dist)', 3)} distance,
           {rd('avg(dn)')} dn
    from {{bad_points}}""")
def _cluster_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What the rows of the summary add up to, whichever points are in which cluster."""
    def overall(c: str) -> Column:
        return F.sum(F.col("n") * F.col(c)) / F.sum("n")

    return experts.cluster_summary(_clustered(spark, sf)).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("n"), r(F.max("max_error"), 6).alias("max_error"),
        r(overall("center_distance"), 3).alias("distance"), r(overall("center_dn")).alias("dn"),
    )


@query("cluster_hulls", "select sample_id, true inside, true corners_are_points from {bad_points}")
def _cluster_hulls(spark: SparkSession, sf: str) -> DataFrame:
    """inside: the hull of a point's cluster holds it; corners_are_points: hulls have no other corners."""
    points = materialize(_clustered(spark, sf), "clustered")
    hulls = materialize(experts.cluster_hulls(points), "hulls")
    foreign = hulls.join(points.select("cluster", F.col("calc_dist").alias("px"), F.col("dn").alias("py")),
                         ["cluster", "px", "py"], "left_anti")
    rings = hulls.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("vertex", "px", "py"))).alias("_ring"))

    def left_of(a: Column, i: Column) -> Column:
        b = F.get("_ring", (i + 1) % F.size("_ring"))
        dx, dy = b["px"] - a["px"], b["py"] - a["py"]
        side = dx * (F.col("dn") - a["py"]) - dy * (F.col("calc_dist") - a["px"])
        return side >= -1e-9 * (F.abs(dx) + F.abs(dy)) * (1 + F.abs("calc_dist") + F.abs("dn"))

    misses = F.exists(F.transform("_ring", lambda a, i: left_of(a, i)), lambda ok: ~ok)
    return salted_join(points, materialize(rings, "rings"), ["cluster"]).select(
        "sample_id", (~misses).alias("inside"), F.lit(foreign.isEmpty()).alias("corners_are_points")
    )


# ---- jobs on the real map features --------------------------------------------------------


def _maps(spark: SparkSession, sf: str) -> jobs.Maps:
    return jobs.Maps(
        table(spark, sf, "tx_sites"), polygons(spark, sf, "buildings"), pixels(spark, sf),
        table(spark, sf, "raster_meta"), polygons(spark, sf, "landuse"),
    )


def _all_features(spark: SparkSession, sf: str) -> DataFrame:
    """All measured sites, stored as feature sets and read back by id."""
    folder = new_folder(spark, "feature-sets")
    rows = _maps(spark, sf).features(table(spark, sf, "measurements"))
    files.write_features(rows.withColumn("dataset_id", F.col("site_id")), folder)
    return spark.read.parquet(folder).drop("dataset_id")


def _held_out_sql(rows: str, share: str, *facts: str) -> str:
    """Both twins of the first ``share`` of the permuted samples of ``rows`` (sample_id, rssi)."""
    return f"""
    select sample_id || '-' || flipped row_id, sample_id, {rd('rssi', 6)} rssi, {', '.join(f'true {f}' for f in facts)}
    from (select sample_id, rssi, count(*) over () n,
                 row_number() over (order by md5('{SEED}-' || sample_id), sample_id) position from {rows}) q,
         (select unnest(['false', 'true']) flipped) t
    where position <= floor(n * {share})"""


def _held_out(trained: jobs.Trained) -> DataFrame:
    """Held-out predictions of the boosted experts."""
    return materialize(
        experts.predict_experts(trained.experts, trained.test, jobs._path_loss(trained.test), trained.inputs), "held-out"
    )


def _job_rows(trained: jobs.Trained, **facts: Column | bool) -> DataFrame:
    """Held-out rows and facts.

    linear_rows: every row has one finite linear prediction of each expert;
    beats_free_space: the experts' median errs less than free-space loss does.
    """
    out = _held_out(trained)
    line = trained.linear.groupBy("row_id").agg(
        (F.count_if(F.col("pred").isNotNull() & ~F.isnan("pred")) == len(trained.experts)).alias("linear_rows")
    )
    free = _error(out, "rssi", jobs._path_loss(out))
    beats = F.lit(out.isEmpty() or _error(out, "rssi") < free)
    return out.join(line, "row_id", "left").select(
        "row_id", "sample_id", r("rssi", 6).alias("rssi"), F.coalesce("linear_rows", F.lit(False)).alias("linear_rows"),
        beats.alias("beats_free_space"),
    )


_JOB_FACTS = ("linear_rows", "beats_free_space")


@query("job_train", _held_out_sql("{measurements}", "0.15e0", *_JOB_FACTS, "same"))
def _job_train(spark: SparkSession, sf: str) -> DataFrame:
    """same: the stored bundle predicts exactly what the fitted experts do."""
    trained = jobs.train(_all_features(spark, sf), K)
    folder = new_folder(spark, "ensemble")
    files.write_ensemble(
        trained.experts, folder, spark, linear=trained.linear, held_out=trained.test, n_experts=K
    )
    stored = files.read_bundle(spark, folder)
    back = jobs.Trained(stored["experts"], stored["held_out"], stored["linear"])
    return _job_rows(back).join(_same_models(_held_out(trained), _held_out(back), "row_id"), "row_id")


_NEW_SITES = "(select * from {measurements} where site_id >= 13) m"


@query("job_transfer", _held_out_sql(_NEW_SITES, "0.1e0", *_JOB_FACTS))
def _job_transfer(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _old_and_new(_all_features(spark, sf))
    base = jobs.train(old, K)
    return _job_rows(jobs.transfer(base.experts, new, 0.1))


@query("job_transfer_incremental", _held_out_sql(_NEW_SITES, "0.1e0", *_JOB_FACTS))
def _job_transfer_incremental(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _old_and_new(_all_features(spark, sf))
    base = jobs.train(old, K)
    return _job_rows(jobs.transfer(base.experts, new, 0.1, incremental_from=old))


@query("job_nearfield_finetune", _held_out_sql("""
    (select bench_id || '-' || i sample_id, first_rssi - i * 0.5e0 rssi
     from {nearfield}, range(0, 5) t(i) where i < n_readings) m""", "0.1e0", *_JOB_FACTS))
def _job_nearfield_finetune(spark: SparkSession, sf: str) -> DataFrame:
    maps = _maps(spark, sf)
    rows, inputs = maps.shared_input(table(spark, sf, "measurements"), twins=True)
    base = jobs.train(rows, K, inputs=inputs)
    return _job_rows(jobs.nearfield_fine_tune(benches(spark, sf), base.experts, maps, share=0.1))


def _site_areas(spark: SparkSession, sf: str) -> DataFrame:
    """The measured box of every site; the mesh gets finer with the number of readings."""
    side = (1 + F.ceil(F.sqrt(F.count(F.lit(1))) / 2)).cast("int")
    return table(spark, sf, "measurements").groupBy("site_id").agg(
        F.min("site_id").alias("area_id"), F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"),
        F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"), side.alias("n"), side.alias("m"),
    )


PARTS["site_areas"] = """
    select site_id, min(longitude) lon_min, max(longitude) lon_max, min(latitude) lat_min, max(latitude) lat_max,
           case when min(longitude) = max(longitude) and min(latitude) = max(latitude) then 1
                else 1 + cast(ceil(sqrt(count(*)) / 2) as bigint) end side
    from {measurements} group by site_id"""


@query("job_predict_area", f"""
    select site_id || '-' || (i * side + j) sample_id,
           {rd('lon_min + j * case when side > 1 then (lon_max - lon_min) / (side - 1) else 0e0 end', 6)} longitude,
           {rd('lat_min + i * case when side > 1 then (lat_max - lat_min) / (side - 1) else 0e0 end', 6)} latitude,
           true is_median, true is_spread
    from {{site_areas}}, lateral (select unnest(range(0, side)) j) a, lateral (select unnest(range(0, side)) i) b""")
def _job_predict_area(spark: SparkSession, sf: str) -> DataFrame:
    """is_median, is_spread: value and uncertainty of every mesh point are the experts' median and deviation."""
    maps = _maps(spark, sf)
    trained = jobs.train(maps.model_input(table(spark, sf, "measurements"), twins=True), K)
    out = jobs.predict_area(
        materialize(_site_areas(spark, sf), "areas"), trained.experts, maps, new_folder(spark, "area"), "20240101_000000"
    )
    return out.select(
        "sample_id", r("longitude", 6).alias("longitude"), r("latitude", 6).alias("latitude"),
        _close(F.col("predicted_value"), _middle()).alias("is_median"),
        _close(F.col("uncertainty"), _deviation(), 1e-6).alias("is_spread"),
    )


@query("job_predict_file", f"""
    select site_id, {rd('longitude', 6)} longitude, {rd('latitude', 6)} latitude, {rd('rssi', 6)} rssi,
           true is_median, true judged
    from (select distinct site_id, longitude, latitude, rssi from {{measurements}}) q""")
def _job_predict_file(spark: SparkSession, sf: str) -> DataFrame:
    """Every measured point from a user's file, with the judge read back from the bundle.

    Shown are the points and facts that hold for any fit: the prediction is the median
    of the experts, and the judge moved it by a finite amount.
    """
    maps, source, bundle = _maps(spark, sf), new_folder(spark, "point-file"), new_folder(spark, "ensemble")
    measured = table(spark, sf, "measurements")
    own = measured.select(
        F.col("latitude").alias("Latitude"), F.col("longitude").alias("Longitude"), F.col("rssi").alias("RSSI"), "site_id"
    )
    files.write_csv(own.unionByName(own), f"{source}/points.csv")
    rows = materialize(maps.model_input(measured, twins=True), "twins")
    trained = jobs.train(rows, K)
    judge = jobs.fit_judge(rows.where("not flipped").drop("flipped"), K)
    files.write_ensemble(trained.experts, bundle, spark, judge=judge, n_experts=K)
    stored = files.read_bundle(spark, bundle)
    out = jobs.predict_file(
        spark, source, stored["experts"], maps, new_folder(spark, "file"), "20240101_000000", stored["judge"]
    )
    shift = F.col("predicted_value_judge") - F.col("predicted_value")
    middle = F.sort_array(F.array(*_MODELS))[K // 2]
    return out.select(
        F.col("site_id").cast("int").alias("site_id"), *[r(c, 6).alias(c) for c in ("longitude", "latitude", "rssi")],
        (F.abs(F.col("predicted_value") - middle) < 1e-9).alias("is_median"),
        (shift.isNotNull() & (F.abs(shift) < F.lit(1e6))).alias("judged"),
    )
