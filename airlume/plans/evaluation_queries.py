"""Ensemble statistics and evaluation reports with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlume.operators import ensemble, evaluation, splits
from airlume.plans import parts
from airlume.plans.geometry_queries import r
from airlume.plans.ingest_queries import bin_sql, predictions
from airlume.plans.registry import PARTS, query, rd
from airlume.sources.derived import MODEL_COLUMNS, table

RHO = 10.0


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


@query("ensemble_stats", f"""
    select sample_id, {rd('predicted_value', 6)} predicted_value, {rd('uncertainty', 6)} uncertainty from {{stats}}""")
def _ensemble_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = ensemble.ensemble_stats(table(spark, sf, "predictions"), MODEL_COLUMNS)
    return _rounded(stats.select("sample_id", "predicted_value", "uncertainty"), "predicted_value", "uncertainty")


@query("abs_error", f"select sample_id, {rd('abs_error', 6)} abs_error from {{stats}}")
def _abs_error(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(predictions(spark, sf).select("sample_id", "abs_error"), "abs_error")


@query("filter_bad_points", f"""
    select sample_id, {rd('abs_error', 6)} abs_error from {{stats}}
    where abs_error > 4.79e0 and (select count(*) from {{stats}} where abs_error > 4.79e0) >= 3""")
def _filter_bad_points(spark: SparkSession, sf: str) -> DataFrame:
    bad = evaluation.filter_bad_points(predictions(spark, sf), 4.79, 3)
    return _rounded(bad.select("sample_id", "abs_error"), "abs_error")


@query("best_expert", f"""
    select sample_id, best_model_idx, {rd('best_model_error', 6)} best_model_error from {{winners}}""")
def _best_expert(spark: SparkSession, sf: str) -> DataFrame:
    best = ensemble.best_expert(table(spark, sf, "predictions"), MODEL_COLUMNS)
    return _rounded(best.select("sample_id", "best_model_idx", "best_model_error"), "best_model_error")


# Bias table: the even bands train, the whole table is corrected.
_EDGES = "(select min(distance_m) d1, max(distance_m) d2, min(dn) n1, max(dn) n2 from {predictions} where band = '220') e"
_BINS = f"{bin_sql('dn', 'n1', 'n2', 20)} dn_bin, {bin_sql('distance_m', 'd1', 'd2', 100)} distance_m_bin"
PARTS["bias_table"] = f"""
    select dn_bin, distance_m_bin, avg(abs(off) / (s1 + 1e-9)) k, avg(sign(off)) sign, count(*) n
    from (select round({parts.MEDIAN} - rssi, 9) off, {parts.spread(1)} s1, {_BINS}
          from {{predictions}}, {_EDGES} where band = '220') q
    group by 1, 2"""
PARTS["bias_lookup"] = f"""
    select p.sample_id, p.med, p.s0, p.rssi, coalesce(t.k, 0e0) k, coalesce(t.sign, 0e0) sign
    from (select sample_id, rssi, {parts.MEDIAN} med, {parts.spread(0)} s0, {_BINS} from {{predictions}}, {_EDGES}) p
    left join {{bias_table}} t on t.dn_bin = p.dn_bin and t.distance_m_bin = p.distance_m_bin"""
_CORRECTED = "case when abs(sign) > 0.75e0 then med - sign * k * s0 else med end"


def _train(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "predictions").where("band = '220'")


@query("calibration_table", f"""
    select dn_bin, distance_m_bin, {rd('k')} k, {rd('sign', 6)} sign, n from {{bias_table}}""")
def _calibration_table(spark: SparkSession, sf: str) -> DataFrame:
    bias = ensemble.calibration_table(_train(spark, sf), MODEL_COLUMNS)
    return bias.withColumns({"k": r("k"), "sign": r("sign", 6)})


@query("calibration_lookup", f"select sample_id, {rd('k')} k, {rd('sign', 6)} sign from {{bias_lookup}}")
def _calibration_lookup(spark: SparkSession, sf: str) -> DataFrame:
    train = _train(spark, sf)
    edges = ensemble.bin_edges(train, ensemble._BINS)
    bias = ensemble.calibration_table(train, MODEL_COLUMNS, edges)
    found = ensemble.calibration_lookup(table(spark, sf, "predictions"), bias, edges)
    return found.select("sample_id", r("k").alias("k"), r("sign", 6).alias("sign"))


@query("judge_bias_correction", f"select sample_id, {rd('med')} predicted_value, {rd(_CORRECTED)} corrected from {{bias_lookup}}")
def _judge_bias_correction(spark: SparkSession, sf: str) -> DataFrame:
    fixed = ensemble.judge_bias_correction(_train(spark, sf), table(spark, sf, "predictions"), MODEL_COLUMNS)
    return fixed.select("sample_id", r("predicted_value").alias("predicted_value"), r("corrected").alias("corrected"))


@query("error_summary", f"""
    select count(*) n, {rd('avg(abs(med - rssi))')} mae_median, {rd(f'avg(abs({_CORRECTED} - rssi))')} mae_corrected
    from {{bias_lookup}}""")
def _error_summary(spark: SparkSession, sf: str) -> DataFrame:
    fixed = ensemble.judge_bias_correction(_train(spark, sf), table(spark, sf, "predictions"), MODEL_COLUMNS)
    return _rounded(ensemble.error_summary(fixed, "corrected"), "mae_median", "mae_corrected", digits=4)


@query("error_percentiles", f"""
    select band, {rd('min(abs_error) filter (where c >= 0.5e0)', 6)} p50, {rd('min(abs_error) filter (where c >= 0.8e0)', 6)} p80
    from (select band, abs_error, cume_dist() over (partition by band order by abs_error) c from {{stats}}) q
    group by band""")
def _error_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluation.error_percentiles(predictions(spark, sf), "abs_error", ["band"]), "p50", "p80")


@query("error_cdf", f"""
    select {rd('abs_error', 6)} abs_error,
           {rd('row_number() over (order by abs_error, sample_id) / count(*) over ()', 9)} cdf
    from {{stats}}""")
def _error_cdf(spark: SparkSession, sf: str) -> DataFrame:
    cdf = evaluation.error_cdf(predictions(spark, sf), "abs_error", "sample_id")
    return cdf.select(r("abs_error", 6).alias("abs_error"), r("cdf", 9).alias("cdf"))


@query("oracle_cdf", f"""
    select model, {rd('error', 6)} error,
           {rd('row_number() over (partition by model order by error) / count(*) over (partition by model)', 9)} cdf
    from (select 'oracle' model, round(best_model_error, 9) error from {{winners}}
          union all select 'model_' || expert_id, round(err, 9) from {{expert_errors}}) q""")
def _oracle_cdf(spark: SparkSession, sf: str) -> DataFrame:
    cdf = evaluation.oracle_cdf(table(spark, sf, "predictions"), MODEL_COLUMNS)
    return cdf.select("model", r("error", 6).alias("error"), r("cdf", 9).alias("cdf"))


@query("decile_strata", """
    select sample_id, cast((select count(*) from range(1, 10) t(i) where rn - 1 >= floor(i * 0.1e0 * n)) as int) stratum
    from (select sample_id, row_number() over (order by uncertainty desc, sample_id) rn, count(*) over () n
          from {stats}) q""")
def _decile_strata(spark: SparkSession, sf: str) -> DataFrame:
    strata = evaluation.decile_strata(predictions(spark, sf), [F.desc("uncertainty"), "sample_id"])
    return strata.select("sample_id", "stratum")


def box_sql(rows: str, group: str, value: str, digits: int = 6) -> str:
    """Box-plot numbers per group from a sub-select."""
    quartiles = f"""select {group}, quantile_cont({value}, 0.25) q1, quantile_cont({value}, 0.5) med,
        quantile_cont({value}, 0.75) q3, count(*) n from ({rows}) a group by {group}"""
    keys = [k.strip() for k in group.split(",")]
    on = " and ".join(f"b.{k} = v.{k}" for k in keys)
    names = ", ".join(f"b.{k}" for k in keys)
    low, high = f"v.{value} >= b.q1 - 1.5e0 * (b.q3 - b.q1)", f"v.{value} <= b.q3 + 1.5e0 * (b.q3 - b.q1)"
    return f"""
    select {names}, b.n, {rd('b.q1', digits)} q1, {rd('b.med', digits)} med, {rd('b.q3', digits)} q3,
           {rd(f'least(min(v.{value}) filter (where {low}), b.q1)', digits)} whisker_lo,
           {rd(f'greatest(max(v.{value}) filter (where {high}), b.q3)', digits)} whisker_hi,
           count(*) filter (where not ({low} and {high})) n_outliers
    from ({quartiles}) b join ({rows}) v on {on} group by {names}, b.n, b.q1, b.med, b.q3"""


_BOX = ("q1", "med", "q3", "whisker_lo", "whisker_hi")


@query("box_stats", box_sql("select band, distance_m from {predictions}", "band", "distance_m"))
def _box_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluation.box_stats(table(spark, sf, "predictions"), "distance_m", ["band"]), *_BOX)


def _expert_boxes_sql() -> str:
    pieces = []
    for quantity in ("distance_m", "dn"):
        rows = f"select best_model_idx expert_id, {quantity} v from {{winners}}"
        pieces.append(
            f"""select cast(s.i as int) expert_id, '{quantity}' quantity, coalesce(x.n, 0) n, x.q1, x.med, x.q3,
                x.whisker_lo, x.whisker_hi, x.n_outliers
            from range(0, 30) s(i) left join ({box_sql(rows, 'expert_id', 'v')}) x on x.expert_id = s.i"""
        )
    return "\nunion all\n".join(pieces)


@query("boxes_per_expert", _expert_boxes_sql())
def _boxes_per_expert(spark: SparkSession, sf: str) -> DataFrame:
    best = ensemble.best_expert(table(spark, sf, "predictions"), MODEL_COLUMNS)
    return _rounded(evaluation.boxes_per_expert(best, ["distance_m", "dn"]), *_BOX)


_BIN = "case when uncertainty between 0 and 3 then '0-3 dB' when uncertainty <= 5 then '3-5 dB' when uncertainty > 5 then '> 5 dB' end"


@query("uncertainty_bin_boxes", box_sql(f"select band, {_BIN} bin, abs_error from {{stats}}", "band, bin", "abs_error"))
def _uncertainty_bin_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluation.uncertainty_bin_boxes(predictions(spark, sf)), *_BOX)


@query("high_error_probability", f"""
    select b.band, g.bin, count(s.bin) n,
           {rd('case when count(s.bin) > 0 then 100e0 * count(*) filter (where s.abs_error > 10) / count(s.bin) else 0e0 end', 6)} pct_high
    from (select distinct band from {{stats}}) b
    cross join (select distinct {_BIN} bin from {{stats}}) g
    left join (select band, {_BIN} bin, abs_error from {{stats}}) s on s.band = b.band and s.bin = g.bin
    group by 1, 2""")
def _high_error_probability(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluation.high_error_probability(predictions(spark, sf)), "pct_high")


PARTS["segments"] = """
    select s.*, case when uncertainty <= q20 then 'low' when uncertainty <= q80 then 'mid' else 'high' end segment
    from {stats} s join (select band, quantile_cont(uncertainty, 0.2) q20, quantile_cont(uncertainty, 0.8) q80
                         from {stats} group by band) q on q.band = s.band"""


@query("quantile_boxes", box_sql("select band, segment, abs_error from {segments}", "band, segment", "abs_error"))
def _quantile_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluation.quantile_boxes(predictions(spark, sf)), *_BOX)


@query("quantile_high_error_rate", f"""
    select band, segment, count(*) n, {rd('100e0 * count(*) filter (where abs_error > 10) / count(*)', 6)} pct_high
    from {{segments}} group by 1, 2""")
def quantile_high_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluation.quantile_high_error_rate(predictions(spark, sf), RHO), "pct_high")


@query("top_uncertainty_trend", f"""
    select cast(p as int) top_pct, count(*) n, {rd('100e0 * count(*) filter (where abs_error > 10) / count(*)', 6)} pct_high
    from (select unnest(range(10, 101, 10)) p,
                 unnest((select quantile_cont(uncertainty, [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0]) from {{stats}})) cut) c
    join {{stats}} s on s.uncertainty >= c.cut group by 1""")
def _top_uncertainty_trend(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluation.top_uncertainty_trend(predictions(spark, sf), RHO), "pct_high")


@query("top_error_distribution", f"""
    select stratum, n_bad, {rd('100e0 * n_bad / sum(n_bad) over ()', 6)} pct
    from (select stratum, count(*) filter (where abs_error > (select quantile_cont(abs_error, 0.9) from {{stats}})) n_bad
          from (select abs_error, cast((select count(*) from range(1, 10) t(i) where rn - 1 >= floor(i * 0.1e0 * n)) as int) stratum
                from (select abs_error, row_number() over (order by uncertainty desc, sample_id) rn, count(*) over () n
                      from {{stats}}) a) b group by stratum) c""")
def _top_error_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluation.top_error_distribution(predictions(spark, sf)), "pct")


def _split_sql(mode: str) -> str:
    order = {
        "high": "uncertainty desc, sample_id", "low": "uncertainty, sample_id",
        "random": "md5('42-' || sample_id), sample_id",
    }[mode]
    return f"""
    select sample_id, '{mode}' mode, case when rn <= greatest(floor(0.1e0 * n), 1) then 'ft' else 'test' end part
    from (select sample_id, row_number() over (order by {order}) rn, count(*) over () n from {{stats}}) q"""


@query("uncertainty_split", "\nunion all\n".join(_split_sql(m) for m in ("high", "low", "random")))
def _uncertainty_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf).select("sample_id", "uncertainty")
    cut = [
        splits.uncertainty_split(rows, m).select("sample_id", F.lit(m).alias("mode"), "part")
        for m in ("high", "low", "random")
    ]
    return splits.union_datasets(*cut)
