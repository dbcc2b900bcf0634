"""Metrics, statistics and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.catalog.registry import query
from ledgerspark.functions.hashing import poisson1_sql
from ledgerspark.functions.numeric import rounded
from ledgerspark.operators import drift as DR
from ledgerspark.operators import metrics as M
from ledgerspark.operators import stats as S
from ledgerspark.sources import domain as D

SC = D.SCORED_SQL


def scored(spark, sf):
    return D.scored_orders(spark, sf)


AVG_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("roc_auc", f"""WITH {SC}, r AS (SELECT y, {AVG_RANK.format(c='p_base')} AS rk FROM scored)
SELECT round((sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))::DOUBLE), 8) AS roc_auc FROM r""")
def roc_auc(spark, sf):
    return rounded(M.roc_auc(scored(spark, sf), score="p_base"), 8, ["roc_auc"])


@query("pr_auc", f"""WITH {SC}, g AS (SELECT p_base AS s, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM scored GROUP BY 1),
c AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn, sum(pos) OVER () AS tp FROM g)
SELECT round(sum(pos / tp * cp / cn), 8) AS pr_auc FROM c""")
def pr_auc(spark, sf):
    return rounded(M.pr_auc(scored(spark, sf), score="p_base"), 8, ["pr_auc"])


@query("auc_by_fold", f"""WITH {SC}, r AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY p_treat) + (count(*) OVER (PARTITION BY fold, p_treat) - 1) / 2.0 AS rk FROM scored)
SELECT fold, round((sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))::DOUBLE), 8) AS roc_auc FROM r GROUP BY 1""")
def auc_by_fold(spark, sf):
    out = M.curve_metrics(scored(spark, sf), score="p_treat", keys=["fold"])
    return rounded(out.select("fold", "roc_auc"), 8, ["roc_auc"])


@query("brier_mae", f"""WITH {SC} SELECT round(avg((p_base - y) * (p_base - y)), 8) AS brier, round(avg(abs(pred - dollars)), 4) AS mae FROM scored""")
def brier_mae(spark, sf):
    out = scored(spark, sf).agg(
        M.brier(F.col("y"), F.col("p_base")).alias("brier"), M.mae(F.col("dollars"), F.col("pred")).alias("mae"))
    return rounded(rounded(out, 8, ["brier"]), 4, ["mae"])


@query("dollar_recall_at_k", f"""WITH {SC}, o AS (SELECT dollars, row_number() OVER (ORDER BY p_base DESC, md5(CAST(id AS VARCHAR))) AS pos, count(*) OVER () AS n FROM scored)
SELECT round(sum(dollars) FILTER (WHERE pos <= greatest(1, ceil(0.1 * n))) / sum(dollars), 8) AS recall,
  round(100 * sum(dollars) FILTER (WHERE pos <= greatest(1, ceil(0.1 * n))) / sum(dollars), 6) AS recall_pct FROM o""")
def dollar_recall_at_k(spark, sf):
    out = M.dollar_recall_at_k(scored(spark, sf), "dollars", "p_base", 0.10)
    return rounded(rounded(out, 8, ["recall"]), 6, ["recall_pct"])


@query("calibration_bins", f"""WITH {SC}, b AS (SELECT CAST(unnest(generate_series(0, 9)) AS INT) AS bin),
g AS (SELECT (p_base >= 0.1)::INT + (p_base >= 0.2)::INT + (p_base >= 0.3)::INT + (p_base >= 0.4)::INT + (p_base >= 0.5)::INT + (p_base >= 0.6)::INT
  + (p_base >= 0.7)::INT + (p_base >= 0.8)::INT + (p_base >= 0.9)::INT AS bin, avg(p_base) AS mp, avg(y) AS ob, count(*) AS n FROM scored GROUP BY 1)
SELECT b.bin, round(mp, 6) AS mean_predicted, round(ob, 6) AS observed_rate, coalesce(n, 0) AS count FROM b LEFT JOIN g ON b.bin = g.bin""")
def calibration_bins(spark, sf):
    return rounded(M.calibration_bins(scored(spark, sf), p="p_base"), 6, ["mean_predicted", "observed_rate"])


@query("regression_metrics", f"""WITH {SC}, r AS (SELECT dollars, pred, {AVG_RANK.format(c='dollars')} AS a, {AVG_RANK.format(c='pred')} AS b FROM scored)
SELECT round(avg(abs(pred - dollars)), 4) AS mae, round(sqrt(avg((pred - dollars) * (pred - dollars))), 4) AS rmse,
  round(1 - sum((dollars - pred) * (dollars - pred)) / (var_pop(dollars) * count(*)), 8) AS r2, count(*) AS n, round(corr(a, b), 8) AS spearman FROM r""")
def regression_metrics(spark, sf):
    out = M.regression_metrics(scored(spark, sf), "dollars", "pred")
    return rounded(rounded(out, 4, ["mae", "rmse"]), 8, ["r2", "spearman"])


FOLD_SQL = f"""{SC}, md AS (SELECT 'linear' AS model_type, fold, dollars, pred FROM scored UNION ALL SELECT 'flat', fold, dollars, 250000.0 + pred / 10 + (id * 31) % 1000 * 100.0 FROM scored),
r AS (SELECT *, rank() OVER (PARTITION BY model_type, fold ORDER BY dollars) + (count(*) OVER (PARTITION BY model_type, fold, dollars) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY model_type, fold ORDER BY pred) + (count(*) OVER (PARTITION BY model_type, fold, pred) - 1) / 2.0 AS b FROM md),
f AS (SELECT model_type, fold, avg(abs(pred - dollars)) AS mae, sqrt(avg((pred - dollars) * (pred - dollars))) AS rmse,
  1 - sum((dollars - pred) * (dollars - pred)) / (var_pop(dollars) * count(*)) AS r2, corr(a, b) AS spearman, count(*) AS n FROM r GROUP BY ALL)"""


def model_folds(spark, sf):
    base = scored(spark, sf)
    both = base.select(F.lit("linear").alias("model_type"), "fold", "dollars", "pred").unionByName(
        base.select(F.lit("flat").alias("model_type"), "fold", "dollars", 
            (F.lit(250000.0) + F.col("pred") / 10 + F.pmod(F.col("id") * 31, F.lit(1000)) * 100.0).alias("pred")))
    return M.regression_metrics(both, "dollars", "pred", ["model_type", "fold"])


@query("compare_models", f"""WITH {FOLD_SQL} SELECT model_type, round(avg(mae), 5) AS mae_mean, round(stddev_pop(mae), 5) AS mae_std, round(avg(rmse), 5) AS rmse_mean,
  round(stddev_pop(rmse), 5) AS rmse_std, round(avg(r2), 5) AS r2_mean, round(stddev_pop(r2), 5) AS r2_std, round(avg(spearman), 5) AS spearman_mean,
  round(stddev_pop(spearman), 5) AS spearman_std, count(*) AS n_folds, CAST(sum(n) AS BIGINT) AS n_rows FROM f GROUP BY 1""")
def compare_models(spark, sf):
    return M.compare_models(model_folds(spark, sf))


@query("suggest_model", f"""WITH {FOLD_SQL}, c AS (SELECT model_type, round(avg(mae), 5) AS mae_mean, round(stddev_pop(mae), 5) AS mae_std, round(avg(rmse), 5) AS rmse_mean, round(avg(r2), 5) AS r2_mean, round(avg(spearman), 5) AS sp FROM f GROUP BY 1),
o AS (SELECT model_type, mae_mean, mae_std, sp, row_number() OVER (ORDER BY mae_mean, sp DESC) AS k FROM c)
SELECT (SELECT model_type FROM o WHERE k = 1) AS best_model, (SELECT arg_min(model_type, mae_mean) FROM c) AS best_mae, (SELECT arg_min(model_type, rmse_mean) FROM c) AS best_rmse,
  (SELECT arg_max(model_type, r2_mean) FROM c) AS best_r2, (SELECT arg_max(model_type, sp) FROM c) AS best_spearman, (SELECT model_type FROM o WHERE k = 2) AS runner_up,
  round(((SELECT mae_mean FROM o WHERE k = 2) - (SELECT mae_mean FROM o WHERE k = 1)) / (SELECT mae_mean FROM o WHERE k = 1) * 100, 4) AS gap_pct, false AS near_tie,
  (SELECT model_type || ' is recommended: best mae_mean=' || printf('%.5f', mae_mean) || ' (±' || printf('%.5f', mae_std) || '), spearman_mean=' || printf('%.5f', sp) || '.' FROM o WHERE k = 1) AS reason""")
def suggest_model(spark, sf):
    return M.suggest_model(M.compare_models(model_folds(spark, sf)))


@query("lift_table", f"""WITH {SC}, o AS (SELECT dollars, p_treat, ntile(10) OVER (ORDER BY p_treat DESC, md5(CAST(id AS VARCHAR))) AS bin FROM scored)
SELECT bin, count(*) AS n, round(avg(p_treat), 6) AS mean_pred, round(avg(dollars), 4) AS mean_actual, round(avg(dollars) / (SELECT avg(dollars) FROM scored), 8) AS lift FROM o GROUP BY 1""")
def lift_table(spark, sf):
    out = M.lift_table(scored(spark, sf), "dollars", "p_treat")
    return rounded(rounded(rounded(out, 6, ["mean_pred"]), 4, ["mean_actual"]), 8, ["lift"])


@query("band_capture", f"""WITH {SC}, q AS (SELECT quantile_cont(dollars, 0.7) AS th, quantile_cont(dollars, 0.3) AS tl, quantile_cont(p_treat, 0.7) AS ph, quantile_cont(p_treat, 0.3) AS pl FROM scored)
SELECT round(count(*) FILTER (WHERE dollars >= th AND p_treat >= ph) / count(*) FILTER (WHERE dollars >= th), 8) AS top_capture_rate,
  round(count(*) FILTER (WHERE dollars <= tl AND p_treat <= pl) / count(*) FILTER (WHERE dollars <= tl), 8) AS bottom_capture_rate,
  count(*) FILTER (WHERE dollars >= th) AS n_true_top, count(*) FILTER (WHERE dollars <= tl) AS n_true_bottom,
  count(*) FILTER (WHERE p_treat >= ph) AS n_pred_top, count(*) FILTER (WHERE p_treat <= pl) AS n_pred_bottom FROM scored, q""")
def band_capture(spark, sf):
    return rounded(M.band_capture(scored(spark, sf), "dollars", "p_treat"), 8, ["top_capture_rate", "bottom_capture_rate"])


@query("residual_summary", f"""WITH {SC} SELECT id, dollars AS true_score, round(pred, 4) AS oof_pred, round(pred - dollars, 4) AS residual, round(abs(pred - dollars), 4) AS abs_error FROM scored""")
def residual_summary(spark, sf):
    return rounded(M.residual_summary(scored(spark, sf), "id", "dollars", "pred"), 4, ["oof_pred", "residual", "abs_error"])


N_BOOT = 150
BOOT_SQL = f"""{SC}, rep AS (SELECT unnest(generate_series(0, {N_BOOT})) AS replicate),
u AS (SELECT scored.*, replicate, CASE WHEN replicate = 0 THEN 0 ELSE CAST('0x' || substr(md5('42|' || ((replicate - 1) // 4) || '|' || id), 1 + 8 * ((replicate - 1) % 4), 8) AS UBIGINT) / 4294967296.0::DOUBLE END AS u FROM scored, rep),
drawn AS (SELECT *, CASE WHEN replicate = 0 THEN 1 ELSE {poisson1_sql('u')} END AS w FROM u)"""
BOOT_TAIL = """SELECT round(max(b) FILTER (WHERE replicate = 0), 4) AS base, round(max(t) FILTER (WHERE replicate = 0), 4) AS treatment,
  round(max(t - b) FILTER (WHERE replicate = 0), 4) AS delta, round(quantile_cont(t - b, 0.025) FILTER (WHERE replicate > 0), 4) AS ci_low,
  round(quantile_cont(t - b, 0.975) FILTER (WHERE replicate > 0), 4) AS ci_high,
  round(least(1.0, 2 * least(avg((t - b <= 0)::INT) FILTER (WHERE replicate > 0), avg((t - b >= 0)::INT) FILTER (WHERE replicate > 0))), 4) AS p_value,
  quantile_cont(t - b, 0.025) FILTER (WHERE replicate > 0) > 0 OR quantile_cont(t - b, 0.975) FILTER (WHERE replicate > 0) < 0 AS significant FROM rp"""


@query("paired_bootstrap", f"""WITH {BOOT_SQL}, rp AS (SELECT replicate, sum(w * (p_base - y) * (p_base - y)) / sum(w) AS b, sum(w * (p_treat - y) * (p_treat - y)) / sum(w) AS t
  FROM drawn WHERE w > 0 GROUP BY 1) {BOOT_TAIL}""")
def paired_bootstrap(spark, sf):
    return S.paired_bootstrap(scored(spark, sf), S.weighted_brier("y"), "p_base", "p_treat", n_boot=N_BOOT)


def _boot_ap(score: str) -> str:
    return f"""SELECT replicate, sum(pos / tp * cp / cn) AS v FROM (SELECT replicate, pos, sum(pos) OVER (PARTITION BY replicate ORDER BY s DESC) AS cp,
      sum(n) OVER (PARTITION BY replicate ORDER BY s DESC) AS cn, sum(pos) OVER (PARTITION BY replicate) AS tp
      FROM (SELECT replicate, {score} AS s, sum(w * y)::DOUBLE AS pos, sum(w)::DOUBLE AS n FROM drawn WHERE w > 0 GROUP BY ALL)) GROUP BY 1"""


@query("bootstrap_pr_auc", f"""WITH {BOOT_SQL}, rb AS ({_boot_ap('p_base')}), rt AS ({_boot_ap('p_treat')}),
rp AS (SELECT replicate, rb.v AS b, rt.v AS t FROM rb JOIN rt USING (replicate)) {BOOT_TAIL}""")
def bootstrap_pr_auc(spark, sf):
    return S.bootstrap_pr_auc(scored(spark, sf), "p_base", "p_treat", n_boot=N_BOOT)


def _boot_recall(score: str, dollars: str = "dollars", part: str = "") -> str:
    """Weighted rows up to ceil(k n) by score, the row at the cut in part."""
    by = f"PARTITION BY {part}replicate"
    return f"""SELECT {part}replicate, sum(usd * greatest(0.0, least(1.0, (k - (cw - w)) / w))) / max(tot) AS v FROM (
      SELECT {part}replicate, w, w * {dollars} AS usd, sum(w) OVER ({by} ORDER BY {score} DESC, md5(CAST(id AS VARCHAR)) ROWS UNBOUNDED PRECEDING) AS cw,
        greatest(1, ceil(0.1 * sum(w) OVER ({by}))) AS k, sum(w * {dollars}) OVER ({by}) AS tot FROM drawn WHERE w > 0) GROUP BY ALL"""


@query("bootstrap_dollar_recall", f"""WITH {BOOT_SQL}, rb AS ({_boot_recall('p_base')}), rt AS ({_boot_recall('p_treat')}),
rp AS (SELECT replicate, rb.v AS b, rt.v AS t FROM rb JOIN rt USING (replicate)) {BOOT_TAIL}""")
def bootstrap_dollar_recall(spark, sf):
    return S.bootstrap_dollar_recall(scored(spark, sf), "dollars", "p_base", "p_treat", n_boot=N_BOOT)


@query("delong_test", f"""WITH {SC},
n AS (SELECT y, p_base, p_treat,
  (rank() OVER (ORDER BY p_base) + (count(*) OVER (PARTITION BY p_base) - 1) / 2.0) - (rank() OVER (PARTITION BY y ORDER BY p_base) + (count(*) OVER (PARTITION BY y, p_base) - 1) / 2.0) AS ob,
  (rank() OVER (ORDER BY p_treat) + (count(*) OVER (PARTITION BY p_treat) - 1) / 2.0) - (rank() OVER (PARTITION BY y ORDER BY p_treat) + (count(*) OVER (PARTITION BY y, p_treat) - 1) / 2.0) AS ot
  FROM scored),
k AS (SELECT sum(y)::DOUBLE AS m, count(*) - sum(y)::DOUBLE AS nn FROM scored),
v AS (SELECT y, CASE WHEN y = 1 THEN ob / nn ELSE 1 - ob / m END AS vb, CASE WHEN y = 1 THEN ot / nn ELSE 1 - ot / m END AS vt FROM n, k),
s AS (SELECT y, avg(vb) AS mb, avg(vt) AS mt, var_samp(vt - vb) / count(*) AS vd FROM v GROUP BY 1),
o AS (SELECT max(mb) FILTER (WHERE y = 1) AS a, max(mt) FILTER (WHERE y = 1) AS b, sum(vd) AS var FROM s),
z AS (SELECT a, b, CASE WHEN var > 1e-18 THEN (b - a) / sqrt(var) END AS z, 1 / (1 + 0.2316419 * abs((b - a) / sqrt(var))) AS t FROM o),
p AS (SELECT *, CASE WHEN z IS NULL THEN 1.0 ELSE 2 * exp(-z * z / 2) / 2.5066282746310002
  * (0.319381530 * t - 0.356563782 * t ** 2 + 1.781477937 * t ** 3 - 1.821255978 * t ** 4 + 1.330274429 * t ** 5) END AS p FROM z)
SELECT round(a, 4) AS auc_base, round(b, 4) AS auc_treatment, round(b - a, 4) AS delta, round(coalesce(z, 0), 4) AS z, round(p, 4) AS p_value,
  p < 0.05 AND b > a AS significant FROM p""")
def delong_test(spark, sf):
    return S.delong_test(scored(spark, sf))


def _segment_ap(score: str) -> str:
    return f"""SELECT segment, replicate, sum(pos / tp * cp / cn) AS v FROM (SELECT segment, replicate, pos, sum(pos) OVER (PARTITION BY segment, replicate ORDER BY s DESC) AS cp,
      sum(n) OVER (PARTITION BY segment, replicate ORDER BY s DESC) AS cn, sum(pos) OVER (PARTITION BY segment, replicate) AS tp
      FROM (SELECT segment, replicate, {score} AS s, sum(w * y)::DOUBLE AS pos, sum(w)::DOUBLE AS n FROM drawn WHERE w > 0 GROUP BY ALL)) GROUP BY ALL"""


ABLATION_SQL = f"""WITH {BOOT_SQL.rsplit("drawn AS (", 1)[0]}
seg AS (SELECT 'overall' AS segment, * FROM u UNION ALL SELECT 'recurring', * FROM u WHERE grp < 60),
drawn AS (SELECT *, y * dollars AS loss, p_base * dollars AS e_base, p_treat * dollars AS e_treat, CASE WHEN replicate = 0 THEN 1 ELSE {poisson1_sql('u')} END AS w FROM seg),
rp AS (
  SELECT 'brier' AS metric, segment, replicate, sum(w * (p_base - y) * (p_base - y)) / sum(w) AS b, sum(w * (p_treat - y) * (p_treat - y)) / sum(w) AS t FROM drawn GROUP BY ALL
  UNION ALL SELECT 'mae', segment, replicate, sum(w * abs(e_base - loss)) / sum(w), sum(w * abs(e_treat - loss)) / sum(w) FROM drawn GROUP BY ALL
  UNION ALL SELECT 'pr', segment, replicate, rb.v, rt.v FROM ({_segment_ap('p_base')}) rb JOIN ({_segment_ap('p_treat')}) rt USING (segment, replicate)
  UNION ALL SELECT 'rec', segment, replicate, rb.v, rt.v FROM ({_boot_recall('e_base', 'loss', 'segment, ')}) rb JOIN ({_boot_recall('e_treat', 'loss', 'segment, ')}) rt USING (segment, replicate)),
m AS (SELECT segment, metric, round(max(b) FILTER (WHERE replicate = 0), 4) AS base, round(max(t - b) FILTER (WHERE replicate = 0), 4) AS delta,
  quantile_cont(t - b, 0.025) FILTER (WHERE replicate > 0) > 0 OR quantile_cont(t - b, 0.975) FILTER (WHERE replicate > 0) < 0 AS sig FROM rp GROUP BY ALL),
v AS (SELECT segment, bool_or(metric = 'pr' AND delta > 0 AND sig) AS improves_pr_auc, bool_or(metric = 'rec' AND delta > 0 AND sig) AS improves_dollar_recall,
  bool_or(metric = 'brier' AND delta <= 0.005) AS no_material_brier_degradation, bool_or(metric = 'mae' AND delta <= 0.01 * abs(base)) AS no_material_mae_degradation FROM m GROUP BY 1)
SELECT *, (improves_pr_auc OR improves_dollar_recall) AND no_material_brier_degradation AND no_material_mae_degradation AS good_enough FROM v"""


@query("ablation_verdict", ABLATION_SQL)
def ablation_verdict(spark, sf):
    rows = S.segments(scored(spark, sf), F.col("grp") < 60).withColumns({
        "loss": F.col("y") * F.col("dollars"), "e_base": F.col("p_base") * F.col("dollars"),
        "e_treat": F.col("p_treat") * F.col("dollars"),
    })
    metrics = S.ablation_metrics(rows, "y", "loss", "p_base", "p_treat", "e_base", "e_treat", "id", n_boot=N_BOOT)
    return S.ablation_verdict(metrics)


PSI_TAIL = """
e AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) AS q FROM lg WHERE is_ref = 1 GROUP BY 1),
b AS (SELECT lg.feature, is_ref, len(list_filter(q[2:len(q)-1], lambda x: x <= value)) AS bin FROM lg JOIN e USING (feature)),
g AS (SELECT e.feature, unnest(generate_series(0, len(q) - 2)) AS bin FROM e),
c AS (SELECT g.feature, g.bin, count(*) FILTER (WHERE is_ref = 1) AS r, count(*) FILTER (WHERE is_ref = 0) AS a FROM g LEFT JOIN b ON b.feature = g.feature AND b.bin = g.bin GROUP BY ALL),
t AS (SELECT feature, greatest(r / sum(r) OVER (PARTITION BY feature), 1e-6) AS r, greatest(a / sum(a) OVER (PARTITION BY feature), 1e-6) AS a FROM c),
p AS (SELECT feature, sum((a - r) * ln(a / r)) AS v FROM t GROUP BY 1)"""


@query("psi", f"""WITH lg AS (SELECT event_type AS feature, value, (ts < TIMESTAMP '2024-01-16')::INT AS is_ref FROM events), {PSI_TAIL}
SELECT feature, round(v, 6) AS psi FROM p""")
def psi(spark, sf):
    events = D.table(spark, sf, "events").select(F.col("event_type").alias("feature"), "value", "ts")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return rounded(DR.psi_long(events.filter(early), events.filter(~early)), 6, ["psi"])


DRIFT_SQL = f"""WITH src AS (SELECT *, (l_shipdate < TIMESTAMP '1998-07-01')::INT AS is_ref FROM lineitem),
lg AS (SELECT 'l_quantity' AS feature, l_quantity AS value, is_ref FROM src UNION ALL SELECT 'l_extendedprice', l_extendedprice, is_ref FROM src
  UNION ALL SELECT 'l_discount', l_discount, is_ref FROM src UNION ALL SELECT 'l_tax', l_tax, is_ref FROM src), {PSI_TAIL}"""


@query("drift_report", f"""{DRIFT_SQL}
SELECT feature, round(v, 4) AS psi, CASE WHEN v < 0.1 THEN 'stable' WHEN v < 0.25 THEN 'moderate' ELSE 'significant' END AS drift FROM p""")
def drift_report(spark, sf):
    lines = D.table(spark, sf, "lineitem")
    early = F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp_ntz")
    return DR.drift_report(
        lines.filter(early), lines.filter(~early), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("drift_action", f"""{DRIFT_SQL}
SELECT count(*) FILTER (WHERE v >= 0.25) AS n_significant_drift, CASE WHEN count(*) FILTER (WHERE v >= 0.25) > 0 THEN 'retrain' ELSE 'none' END AS action FROM p""")
def drift_action(spark, sf):
    return DR.drift_action(drift_report(spark, sf))
